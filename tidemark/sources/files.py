"""CSV benchmark files, command scripts and directory sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import BENCH, RECOVERY

#: Verbs with the least and most number of arguments.
VERBS = {"SET": (2, 2), "GET": (1, 1), "DELETE": (1, 1), "EXISTS": (1, 1), "STATS": (0, 0), "SCAN": (2, 3), "PING": (0, 0), "BEGIN": (0, 0), "COMMIT": (0, 0), "ROLLBACK": (0, 0)}


def read_bench(spark: SparkSession, path: str, recovery: bool = False) -> DataFrame:
    """Older files lack the last columns, which are null then."""
    return spark.read.schema(RECOVERY if recovery else BENCH).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def directory_bytes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Sum of file sizes below a path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count("*").alias("files"))


def parse_commands(lines: DataFrame, text: str = "line") -> DataFrame:
    """(verb, key, value, error) beside the columns of lines.

    A line is trimmed; the verb may be of any case; a value is the rest of its line.
    """
    t = F.trim(F.col(text))
    verb = F.upper(F.regexp_extract(t, r"^(\S+)", 1))
    rest = F.regexp_extract(t, r"^\S+\s+([\s\S]*)$", 1)
    key = F.regexp_extract(rest, r"^(\S+)", 1)
    value = F.regexp_extract(rest, r"^\S+\s+([\s\S]*)$", 1)
    n = F.when(rest == "", 0).otherwise(F.size(F.split(rest, r"\s+")))
    known = verb.isin(*VERBS)
    least = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in VERBS.items() for x in (k, v[0])]), verb), F.lit(0))
    most = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in VERBS.items() for x in (k, v[1])]), verb), F.lit(0))
    error = F.when(F.coalesce(t, F.lit("")) == "", "empty command").when(~known, "unknown command").when((n < least) | ((n > most) & (verb != "SET")), "wrong number of arguments").when(F.octet_length(key) > 4096, "key too long")
    has = verb.isin("SET", "GET", "DELETE", "EXISTS", "SCAN")
    return lines.select("*", F.when(known, verb).alias("verb"), F.when(error.isNull() & has, key).alias("key"), F.when(error.isNull() & verb.isin("SET", "SCAN"), value).alias("value"), error.alias("error"))


def parse_hex_commands(lines: DataFrame, text: str = "line") -> DataFrame:
    """As parse_commands, of lines whose keys and values are hex: (verb, key, value, end, limit,
    error). `-` is an empty value and `*` an open bound; every verb has a fixed number of arguments."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda x: x != "")
    verb, n = F.upper(F.get(words, F.lit(0))), F.size(words) - 1
    needs = F.element_at(F.create_map(*[F.lit(x) for k, v in VERBS.items() for x in (k, 3 if k == "SCAN" else v[1])]), F.coalesce(verb, F.lit("")))
    a, b, c = (F.get(words, F.lit(i)) for i in (1, 2, 3))
    hexed = lambda x: x.rlike("^([0-9A-Fa-f]{2})*$")
    keyed, scan, put = verb.isin("SET", "GET", "DELETE", "EXISTS"), verb == "SCAN", verb == "SET"
    bad_key = lambda x: (F.length(x) == 0) | (F.length(x) > 8192)
    low = scan & (a != "*")
    high = scan & (b != "*")
    error = (
        F.when(verb.isNull(), "empty command")
        .when(needs.isNull(), "unknown command")
        .when(n != needs, "wrong number of arguments")
        .when(keyed & ~hexed(a), "key is not hex")
        .when(keyed & bad_key(a), "bad key length")
        .when(put & (b != "-") & ~hexed(b), "value is not hex")
        .when(put & (F.length(a) / 2 + F.when(b == "-", 0).otherwise(F.length(b) / 2) + 33 > 1_000_000), "record too large")
        .when(scan & ~F.coalesce(c.rlike("^[0-9]{1,5}$") & c.try_cast("int").between(1, 10_000), F.lit(False)), "bad limit")
        .when((low & ~hexed(a)) | (high & ~hexed(b)), "bound is not hex")
        .when((low & bad_key(a)) | (high & bad_key(b)), "bad key length")
    )
    ok = error.isNull()
    key = F.when(ok & keyed, F.lower(a)).when(ok & scan, F.when(a == "*", "").otherwise(F.lower(a)))
    value = F.when(ok & put, F.when(b == "-", "").otherwise(F.lower(b)))
    end = F.when(ok & high, F.lower(b))
    return lines.select("*", F.when(needs.isNotNull(), verb).alias("verb"), key.alias("key"), value.alias("value"), end.alias("end"), F.when(ok & scan, c.try_cast("int")).alias("limit"), error.alias("error"))


def append_csv(df: DataFrame, path: str) -> None:
    """Add rows to a folder of CSV files, each of which has its header once."""
    df.write.mode("append").option("header", True).csv(path)
