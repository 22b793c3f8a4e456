"""Column profiles of parsed logs, and the encodings they choose, all in column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CANONICAL, entropy_weight, format_field, is_float, wrap32

DICTIONARY_BELOW = 0.5
KEY = ["file", "kind", "tid", "col"]


def long_columns(matched: DataFrame) -> DataFrame:
    """(file, kind, tid, col, line_no, value): header fields of lines that have them, variables of matched lines."""
    none = F.array().cast("array<struct<kind:string,tid:int,col:int,value:string>>")
    cells = lambda c, kind, tid: F.transform(c, lambda x, i: F.struct(F.lit(kind).alias("kind"), tid.cast("int").alias("tid"), i.alias("col"), x.alias("value")))
    heads = F.when(F.col("eid") >= 0, cells("header", "header", F.lit(0))).otherwise(none)
    own = F.when(F.col("eid") > 0, cells("vars", "var", F.col("eid"))).otherwise(none)
    return matched.select("file", "line_no", F.explode(F.concat(heads, own)).alias("c")).select("file", "c.kind", "c.tid", "c.col", "line_no", "c.value")


CHUNK_LINES = 1_000_000


def _chunk(chunk_lines: int):
    return F.floor(F.col("line_no") / chunk_lines)


def with_deltas(columns: DataFrame, key: list[str] = KEY, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """columns with v (whole numbers in canonical form) and d (the difference to the value before, 0 before the first).

    A task sorts a chunk of lines of one column at most; the last value of a chunk, one row,
    is carried to the next that has lines."""
    v = F.when(F.col("value").rlike(CANONICAL), F.col("value").try_cast("long"))
    rows = columns.withColumns({"v": v, "_chunk": _chunk(chunk_lines)})
    ends = rows.groupBy(*key, "_chunk").agg(F.max_by("v", "line_no").alias("_last"))
    ends = ends.select(*key, "_chunk", F.lag(F.struct("_last")).over(Window.partitionBy(*key).orderBy("_chunk")).alias("_ahead"))
    ends = ends.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), F.col("_chunk").alias("_kc"), F.when(F.col("_ahead").isNull(), F.lit(0)).otherwise(F.col("_ahead._last")).alias("_ahead"))
    inner = Window.partitionBy(*key, "_chunk").orderBy("line_no")
    rows = rows.withColumn("_before", F.lag(F.struct("v")).over(inner))
    same = F.col("_chunk") == F.col("_kc")
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    both = rows.join(ends, same)
    before = F.when(F.col("_before").isNull(), F.col("_ahead")).otherwise(F.col("_before.v"))
    return both.select(*columns.columns, "v", F.try_subtract(F.col("v"), before).alias("d"))


def entropies(columns: DataFrame, value: str, key: list[str] = KEY) -> DataFrame:
    """Shannon and log-weighted entropy (bits) of each column: two aggregations, the first partial."""
    counts = columns.groupBy(*key, F.col(value).alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    weight, bits = entropy_weight(F.col("_x").cast("double")), F.col("_c") * F.log2("_c")
    total = counts.groupBy(*key).agg(F.sum("_c").alias("_n"), F.sum(bits).alias("_b"), F.sum(F.col("_c") * weight).alias("_w"), F.sum(bits * weight).alias("_wb"))
    return total.select(*key, (F.log2("_n") - F.col("_b") / F.col("_n")).alias("shannon"), ((F.log2("_n") * F.col("_w") - F.col("_wb")) / F.col("_n")).alias("weighted"))


def profile(columns: DataFrame, key: list[str] = KEY, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """One count of values and differences gives all: n, n_distinct, distinct ratio, entropies of values and differences, and the chosen encoding.

    Delta first (canonical whole numbers whose differences weigh no more, none below -1), then a
    dictionary (at least three rows, less than half of them distinct), else raw."""
    rows = with_deltas(columns, key, chunk_lines).withColumn("_ok", F.col("d").isNotNull())
    both = rows.select(*key, "_ok", F.explode(F.array(F.struct(F.lit("v").alias("w"), F.col("value").alias("x")), F.struct(F.lit("d").alias("w"), F.col("d").cast("string").alias("x")))).alias("c"))
    counts = both.groupBy(*key, F.col("c.w").alias("w"), F.col("c.x").alias("x")).agg(F.count(F.lit(1)).alias("c"), F.count_if("_ok").alias("ok"))
    number = F.when(F.col("x").rlike(CANONICAL), F.col("x").try_cast("long"))
    counts = counts.withColumn("i", number).withColumn("weight", F.when(F.col("ok") > 0, entropy_weight(F.col("i").cast("double"))))
    of = lambda w, x: F.when(F.col("w") == w, x)
    bits = F.when(F.col("ok") > 0, F.col("ok") * F.log2("ok"))
    sums = [F.sum(of("v", F.col("c"))).alias("n"), F.count(of("v", F.lit(1))).alias("n_distinct"), F.min(of("v", F.col("i"))).alias("low"), F.max(of("v", F.col("i"))).alias("high"), F.min(of("d", F.col("i"))).alias("low_d")]
    for w in "vd":
        sums += [F.sum(of(w, F.col("ok"))).alias(f"n{w}"), F.sum(of(w, F.col("ok") * F.col("weight"))).alias(f"w{w}"), F.sum(of(w, bits * F.col("weight"))).alias(f"b{w}")]
    entropy = lambda w: F.when(F.col(f"n{w}") > 0, (F.log2(f"n{w}") * F.col(f"w{w}") - F.col(f"b{w}")) / F.col(f"n{w}"))
    out = counts.groupBy(*key).agg(*sums).withColumns({"all_int": F.col("nv") == F.col("n"), "hv": entropy("v"), "hd": entropy("d")})
    ratio = F.col("n_distinct") / F.col("n")
    delta = F.col("all_int") & (F.col("n") > 2) & (F.col("low") >= -1) & (F.col("low_d") >= -1) & (F.col("high") < 2**63 - 1) & (F.col("hd") <= F.col("hv") + 1e-9)
    encoding = F.when(delta, "delta").when((F.col("n") >= 3) & (ratio < DICTIONARY_BELOW), "dict").otherwise("raw")
    return out.select(*key, "n", "n_distinct", ratio.alias("ratio"), F.round("hv", 6).alias("hv"), F.round("hd", 6).alias("hd"), encoding.alias("encoding"))


def dictionaries(columns: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(key, code, value): codes in order of first occurrence."""
    first = columns.groupBy(*key, "value").agg(F.min("line_no").alias("first"))
    return first.withColumn("code", F.row_number().over(Window.partitionBy(*key).orderBy("first", "value")) - 1).select(*key, "code", "value")


def dict_encode(columns: DataFrame, dictionary: DataFrame, key: list[str] = KEY) -> DataFrame:
    return columns.join(dictionary, [*key, "value"]).select(*key, "line_no", "code")


def dict_decode(codes: DataFrame, dictionary: DataFrame, key: list[str] = KEY) -> DataFrame:
    return codes.join(dictionary, [*key, "code"]).select(*key, "line_no", "value")


def delta_decode(deltas: DataFrame, key: list[str] = KEY, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """The values of differences: sums within chunks of lines, and before them the sums of the chunks ahead."""
    rows = deltas.select(*key, "line_no", "d", _chunk(chunk_lines).alias("_chunk"))
    total = rows.groupBy(*key, "_chunk").agg(F.sum("d").alias("_sum"))
    ahead = F.sum("_sum").over(Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    total = total.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), F.col("_chunk").alias("_kc"), F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    same = F.col("_chunk") == F.col("_kc")
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inner = Window.partitionBy(*key, "_chunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_v", F.sum("d").over(inner)).join(total, same).select(*key, "line_no", (F.col("_v") + F.col("_ahead")).alias("v"))


def deltas32(columns: DataFrame, key: list[str] = KEY, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """(key, line_no, d): differences of 32-bit numbers, wrapped to 32 bits."""
    return with_deltas(columns, key, chunk_lines).select(*key, "line_no", wrap32(F.col("d")).alias("d"))


def delta_decode32(deltas: DataFrame, key: list[str] = KEY, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    return delta_decode(deltas, key, chunk_lines).withColumn("v", wrap32(F.col("v")))


def first_occurrences(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Each distinct row of the columns with `first`, the least value of the order column it occurs at."""
    return df.groupBy(*columns).agg(F.min(order).alias("first"))


def formatted_headers(parsed: DataFrame, schema: DataFrame) -> DataFrame:
    """(file, line_no, formatted): each header field in its format with its delimiter.

    The schema, a row per file and field, becomes a row per file with the fields in order.  Headers of
    fewer fields are joined by spaces as they are."""
    fields = schema.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("field", "format", "delim"))).alias("_f"))
    part = lambda v, f: F.concat(format_field(v, f["format"]), f["delim"])
    short = F.size("header") < F.size("_f")
    whole = F.array_join(F.zip_with("header", "_f", part), "")
    return parsed.join(fields, "file").select("file", "line_no", F.when(short, F.array_join("header", " ")).otherwise(whole).alias("formatted"))


def bit_width(schema: DataFrame, head: int = 5) -> DataFrame:
    """(file, bits): an estimate of a header's bits from the widths of its numeric fields, 8 where a width is not known."""
    width = F.when(F.col("is_numeric"), F.when(F.col("max_len") > 0, F.col("max_len")).otherwise(8)).otherwise(0)
    return schema.groupBy("file").agg((F.sum(width) * head * 4).cast("int").alias("bits"))


def header_schema(lines: DataFrame, sample: int = 1000, head: int = 5) -> DataFrame:
    """Per file and header field: numeric or not, printf format, width (numeric fields), delimiter."""
    from .mining import parsed

    cells = parsed(lines.where(F.col("line_no") < sample), head).select("file", "line_no", F.posexplode("header").alias("field", "value"))
    agg = cells.groupBy("file", "field").agg(F.bool_and(is_float(F.col("value"))).alias("is_numeric"), F.min_by("value", "line_no").alias("first"), F.max(F.octet_length("value")).alias("width"))
    form = F.when(~F.col("is_numeric"), "%s").when(F.col("first").rlike(r"^[0-9]+\.[0-9]+$"), "%f").otherwise("%d")
    return agg.select("file", "field", "is_numeric", form.alias("format"), F.when(F.col("is_numeric"), F.col("width")).otherwise(-1).cast("int").alias("max_len"), F.lit(" ").alias("delim"))
