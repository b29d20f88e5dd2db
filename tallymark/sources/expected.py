"""Expected rows from CSV and JSON: valid rows, and an error for each of the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallymark.functions import fixed
from tallymark.functions.text import trim

NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
_TEXTS = (("brand", "Brand name is required"), ("classType", "Class/type designation is required"), ("netContents", "Net contents is required"), ("bottlerName", "Bottler / producer name is required"), ("bottlerAddress", "Bottler / producer address is required"), ("countryOfOrigin", "Country of origin is required"))
ERRORS = "file string, line int, message string"


def issues(column: dict[str, Column]) -> Column:
    """The schema violations of an application, in the order of its fields, as structs (path, msg)."""
    def empty(name: str, said: str) -> tuple[str, Column, str]:
        return name, F.coalesce(column[name] == "", F.lit(True)), said

    said = dict(_TEXTS)
    abv = column["abv"]
    rules = [empty(n, said[n]) for n in ("brand", "classType")]
    rules += [("abv", abv.isNull(), "ABV must be a number"), ("abv", abv < 0, "ABV cannot be negative"), ("abv", abv > 100, "ABV cannot exceed 100")]
    rules += [empty(n, said[n]) for n in ("netContents", "bottlerName", "bottlerAddress", "countryOfOrigin")]
    rules += [("govWarningRequired", column["govWarningRequired"].isNull(), "Required"), ("beverageType", ~F.coalesce(column["beverageType"].isin(*fixed.BEVERAGES), F.lit(False)), "Invalid enum value")]
    return F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(path).alias("path"), F.lit(text).alias("msg"))) for path, bad, text in rules]))


def validate_applications(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """``df`` with ``issues`` (all), ``first_issue`` (path: message, or null) and its notes never null. names: from field to column."""
    columns = {field: F.col(names[field]) if field in names else F.lit("?") for field in fixed.EXPECTED_COLUMNS}
    out = df.withColumn("issues", issues(columns))
    first = F.get("issues", F.lit(0))
    out = out.withColumn("first_issue", F.when(first.isNotNull(), F.concat(first["path"], F.lit(": "), first["msg"])))
    return out.withColumn(names["applicationNotes"], F.coalesce(columns["applicationNotes"], F.lit(""))) if "applicationNotes" in names else out


def _split(rows: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    good = rows.filter("error IS NULL").select("file", "line", *fixed.EXPECTED_COLUMNS)
    return good, rows.filter("error IS NOT NULL").select("file", "line", F.concat(F.lit(f"{label} "), F.col("line").cast("string"), F.lit(": "), F.col("error")).alias("message"))


def _rows_by_header(spark: SparkSession, path: str, width: int) -> DataFrame:
    """file, line, missing (required columns that the file's header lacks), and the columns by the names of each file's own header.

    A file is one task (rows may run over lines), so many files are read at once. The first row of a file names its
    columns; a name that stands there twice is the first of the two. The row of the header itself has line 1.
    """
    cells = StructType([StructField(f"_c{k}", StringType()) for k in range(width)])
    raw = spark.read.schema(cells).csv(path, header=False, multiLine=True, mode="PERMISSIVE")
    only_blanks = (F.trim("_c0") == "") & F.coalesce(*[F.col(c) for c in cells.names[1:]], F.lit(None)).isNull()
    raw = raw.filter(~F.coalesce(only_blanks, F.lit(False)))
    placed = raw.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("_n"), F.array(*cells.names).alias("_cells"))
    in_file = Window.partitionBy("file").orderBy("_n")
    names = F.transform("_head", lambda h: F.regexp_replace(trim(F.coalesce(h, F.lit(""))), "^\ufeff", ""))
    read = placed.select("file", F.row_number().over(in_file).alias("line"), "_cells", F.first("_cells").over(in_file).alias("_head")).withColumn("_names", names)
    required = F.array(*map(F.lit, fixed.EXPECTED_COLUMNS))
    values = [F.coalesce(F.get("_cells", F.array_position("_names", F.lit(c)) - 1), F.lit("")).alias(c) for c in fixed.EXPECTED_COLUMNS]
    return read.select("file", F.col("line").cast("int").alias("line"), F.array_except(required, "_names").alias("missing"), *values)


def read_expected_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of one file or of all files of a folder, each read by its own header.

    Line n is the row's place among those read plus the header's; blank lines do not count. A file whose header lacks a column gives one error
    and no row; the others are not affected.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    # No line has more cells than commas and one; a bound on the width that takes one pass.
    width = lines.filter(F.trim("value") != "").agg(F.max(F.length("value") - F.length(F.replace("value", F.lit(","), F.lit(""))) + 1)).first()[0]
    if not width:
        return spark.createDataFrame([], "file string, line int, " + ", ".join(f"{c} string" for c in fixed.EXPECTED_COLUMNS)), spark.createDataFrame([(path, 0, "CSV is empty.")], ERRORS)
    every = _rows_by_header(spark, path, width)
    blank = lines.groupBy("file").agg(F.max(F.trim("value") != "").alias("any")).filter("NOT any").select("file", F.lit(0).alias("line"), F.lit("CSV is empty.").alias("message"))
    headless = every.filter("line = 1 AND size(missing) > 0").select("file", "line", F.concat(F.lit("CSV header row is missing required column(s): "), F.array_join("missing", ", "), F.lit(".")).alias("message"))
    rows = every.filter("line > 1 AND size(missing) = 0").drop("missing")
    value = {c: trim(F.col(c)) for c in fixed.EXPECTED_COLUMNS}
    abv = F.when(value["abv"].rlike(NUMBER), value["abv"].try_cast("double"))
    flag = F.when(F.lower(value["govWarningRequired"]).isin("true", "yes", "y", "1"), True).when(F.lower(value["govWarningRequired"]).isin("false", "no", "n", "0"), False)
    typed = value | {"abv": abv, "govWarningRequired": flag}
    first = F.get(issues(typed), F.lit(0))

    def got(name: str, said: str) -> Column:
        return F.concat(F.lit(f'{said} (got "'), F.col(name), F.lit('").'))

    error = (
        F.when(value["filename"] == "", "filename is required.")
        .when(abv.isNull(), got("abv", "abv must be a number"))
        .when(flag.isNull(), got("govWarningRequired", "govWarningRequired must be true/false"))
        .when(~value["beverageType"].isin(*fixed.BEVERAGES), got("beverageType", "beverageType must be one of " + "|".join(fixed.BEVERAGES)))
        .when(first.isNotNull(), F.concat(first["path"], F.lit(" — "), first["msg"], F.lit(".")))
    )
    # As the row of a generator: the filters on the error would else be moved below it, with all of it written into them.
    checked = rows.select("file", "line", F.explode(F.array(F.struct(error.alias("error"), *[typed[c].alias(c) for c in fixed.EXPECTED_COLUMNS]))).alias("_row")).select("file", "line", "_row.*")
    good, bad = _split(checked, "Line")
    return good, bad.unionByName(headless).unionByName(blank)


def read_expected_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of files that each hold an array of {filename, expected}. Only file names are trimmed."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))
    kind = F.schema_of_variant("v")
    bad = whole.filter(F.col("v").isNull() | ~kind.startswith("ARRAY")).select("file", F.lit(0).alias("line"), F.when(F.col("v").isNull(), "Could not parse JSON: invalid syntax.").otherwise("JSON must be an array of `{ filename, expected }` rows.").alias("message"))
    entries = whole.filter(F.col("v").isNotNull() & kind.startswith("ARRAY")).select("file", F.posexplode(F.expr("cast(v AS array<variant>)")).alias("pos", "e"))

    def part(where: str, type_name: str, cast: str) -> Column:
        """The value at a path, if it is of that JSON type."""
        at = F.expr(f"try_variant_get(e, '{where}', 'variant')")
        return F.when(F.schema_of_variant(at).rlike(f"^(?:{type_name})"), F.expr(f"try_variant_get(e, '{where}', '{cast}')"))

    typed = {c: part(f"$.expected.{c}", "STRING", "string") for c in fixed.EXPECTED_COLUMNS if c != "filename"}
    typed |= {"filename": F.trim(part("$.filename", "STRING", "string")), "abv": part("$.expected.abv", "BIGINT|DOUBLE|DECIMAL|FLOAT|INT|TINYINT|SMALLINT", "double"), "govWarningRequired": part("$.expected.govWarningRequired", "BOOLEAN", "boolean")}
    first = F.get(issues(typed), F.lit(0))
    is_object = F.coalesce(F.schema_of_variant("e").startswith("OBJECT"), F.lit(False))
    error = F.when(~is_object, "must be an object.").when(F.coalesce(typed["filename"], F.lit("")) == "", "`filename` is required (non-empty string).").when(first.isNotNull(), F.concat(first["path"], F.lit(" — "), first["msg"], F.lit(".")))
    typed["applicationNotes"] = F.coalesce(typed["applicationNotes"], F.lit(""))
    rows, errors = _split(entries.select("file", (F.col("pos") + 1).alias("line"), error.alias("error"), *[typed[c].alias(c) for c in fixed.EXPECTED_COLUMNS]), "Row")
    return rows, errors.unionByName(bad)
