"""Helpers that the corpus operators share: scratch tables, span search and ASCII-only lower-casing."""

from __future__ import annotations

import atexit
import shutil
import string
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.session import ship  # noqa: F401  for the operators

#: Type of the span arrays that `find_spans` returns; offsets are code points, `end` is exclusive.
SPANS = "array<struct<start:int,end:int,value:string>>"

_own: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local tests (where it is unset) a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="lexispark-")
        atexit.register(shutil.rmtree, _own["dir"], True)
    return _own["dir"]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    This cuts lineage in a way that outlives any executor, and because the reread table has no
    partitioning of its own, joins on it get an exchange on both sides, which adaptive execution
    needs in order to split a hot key.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/lexispark/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else (`lower` would also fold other scripts)."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def count_matches(text: Column, pattern: str) -> Column:
    """Matches of `pattern` in `text`; null counts as empty."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, zero: Column, add: Callable[[Column, Column], Column], chunk: int = 64) -> Column:
    """For each element of an array, the fold of all before it (`zero` for the first); `add` must be associative.

    Folded by chunks of 64 and then over the chunks, so that an array of n elements takes some n * (32 + n / 8192) steps and copies nothing that grows.
    """
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / chunk).cast("int")), lambda c: F.slice(v, c * chunk + 1, chunk))
    fold = lambda v: F.aggregate(v, zero, add)

    def spread(s: Column) -> Column:
        part = lambda x, c: let(fold(F.slice(s["sums"], F.lit(1), c)), lambda base: F.transform(x, lambda _, i: F.aggregate(F.slice(x, F.lit(1), i), base, add)))
        return F.flatten(F.transform(s["chunks"], part))

    chunked = lambda v: let(cut(v), lambda c: let(F.struct(c.alias("chunks"), F.transform(c, fold).alias("sums")), spread))
    return let(values, lambda v: F.when(F.size(v) > 0, chunked(v)).otherwise(F.array().cast("array<int>")))


def find_spans(text: Column, pattern: str, gate: Column | None = None, around: tuple[int, int] | None = None) -> Column:
    """Leftmost non-overlapping matches of a Java regex with their code point offsets.

    `split` yields what lies between the matches and `regexp_extract_all` the matches, both by the
    same left-to-right search, so their lengths add up to the offsets. `gate` is a cheap condition that
    holds for every text with a match: other texts are not searched. With `around`, spans have `before` and `after`:
    so many characters of context at most, that reach into the neighbouring match but not past it.
    """
    none = F.array().cast(SPANS if around is None else SPANS[:-2] + ",before:string,after:string>>")

    def placed(x: Column) -> Column:
        def span(hit: Column, i: Column) -> Column:
            gap = F.get(x["gaps"], i)
            start = F.get(x["starts"], i) + F.length(gap)
            fields = [start.alias("start"), (start + F.length(hit)).alias("end"), hit.alias("value")]
            if around is not None:
                previous = F.when(i > 0, F.get(x["hits"], i - 1)).otherwise("")
                follow = F.concat(F.get(x["gaps"], i + 1), F.coalesce(F.get(x["hits"], i + 1), F.lit("")))
                fields += [F.right(F.concat(previous, gap), F.lit(around[0])).alias("before"), F.left(follow, F.lit(around[1])).alias("after")]
            return F.struct(*fields)

        return F.transform(x["hits"], span)

    def found(x: Column) -> Column:
        sizes = F.transform(x["hits"], lambda hit, i: F.length(F.get(x["gaps"], i)) + F.length(hit))
        with_starts = F.struct(x["hits"].alias("hits"), x["gaps"].alias("gaps"), running(sizes, F.lit(0), lambda a, b: a + b).alias("starts"))
        return F.when(F.size(x["hits"]) > 0, let(with_starts, placed)).otherwise(none)

    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))
    spans = let(parts, found)
    return spans if gate is None else F.when(gate, spans).otherwise(none)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_ok(value: Column) -> Column:
    """The Luhn checksum over the digits of `value`; from the right, every second one counts double."""
    digits = digits_of(value)
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).try_cast("int")
        return total + F.when(i % 2 == 1, d).otherwise((2 * d) % 10 + F.when(d >= 5, 1).otherwise(0))

    return F.when(n == 0, F.lit(False)).otherwise(F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0)


def span_string(spans: Column) -> Column:
    """kind:start:end of each span in the order given, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def hash60(*cols: Column) -> Column:
    """60 bits of an MD5 as a long that is not negative; DuckDB can compute the same."""
    joined = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")
