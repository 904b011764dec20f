"""Secrets in texts, and weak parts of credentials that count only together, in DataFrame functions alone.

Three kinds of span count by themselves: ``assign``, a secret that is assigned to a telling name; ``access``, an access
identifier of fixed form; ``hex``, a run of hexadecimal digits. Three weak kinds are common in clean texts and count only where
a complementary part is near: ``id``, a user or client name that is assigned; ``key``, a short or odd value assigned to a
secret's name, or a long run of base64; ``endpoint``, an address of a service. An id needs a secret (assign, hex, key), a key needs
an identifier or an endpoint, an endpoint needs a secret of a name or an access identifier, within ``reach`` code points and
within one scope; scopes are what blank lines part. A weak part that overlaps a span which counts by itself is no part.

Texts are read once: matches of each kind leave as the lengths of what is before them and of themselves, in a written table
without texts. The rest is over these few rows: positions are running sums, scopes are intervals between the breaks, and the
interval join of parts with scopes and with complementary parts is a sweep, one window over a document's parts in order of
begin, so that no pair of parts is ever made. All is dealt once by row number, never by id or source.

Edge cases: null and empty texts hold nothing. Repeated rows and null ids are rows like others. Very long texts are used whole; a
task holds the spans of one document. No rows: no rows. Further columns stay, if they are carried; result columns replace
columns of their own names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import free_name, written

REACH = 400


def either(word: str) -> str:
    """The word in either case, for engines whose case folding differs; only letters of ASCII."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def _named(names: tuple[str, ...], value: str) -> str:
    """One of the names, in quotes or not, with a colon or an equals sign, and a value."""
    return "(" + "|".join(map(either, names)) + ")[\"']?\\x20*[:=]\\x20*[\"']?" + value


_VALUE = "([A-Za-z0-9+/_.=-]+)"
#: Names, schemes and lengths by which parts are known.
SECRET_NAMES = ("password", "passwd", "secret", "token", "api_?key")
WEAK_NAMES = ("password", "passphrase", "passwd", "pass", "pwd", "secret", "token", "api_?key", "private_?key", "credential")
ID_NAMES = ("access_?key_?id", "client_?id", "user_?name", "user_?id", "user", "login", "account")
PLACE_NAMES = ("hostname", "host", "endpoint", "server", "base_?url", "url")
SCHEMES = ("https?", "ftp", "postgresql", "postgres", "mysql", "mongodb", "redis", "amqps?", "s3", "ssh", "jdbc:[a-z0-9]+")
ASSIGN_LEAST = 12

#: Kinds in the order in which spans of one begin are named, with their patterns; the first three count by themselves.
KINDS = {
    "assign": _named(SECRET_NAMES, _VALUE),
    "access": "AKIA[A-Z0-9]{14,}",
    "hex": "[0-9a-f]{16,}",
    "id": _named(ID_NAMES, "[A-Za-z0-9@+_.-]{3,}"),
    "key": _named(WEAK_NAMES, "[^\\x20\\x09-\\x0D\"'<>]{4,}") + "|[A-Za-z0-9+/]{32,}",
    "endpoint": "(" + "|".join(SCHEMES) + ")://[^\\x20\\x09-\\x0D\"'<>]+|" + _named(PLACE_NAMES, "[A-Za-z0-9.:/_-]{4,}"),
}
BASE, WEAK = ("assign", "access", "hex"), ("id", "key", "endpoint")
#: What a weak part needs near it.
COMPLEMENT = {"id": ("assign", "hex", "key"), "key": ("access", "id", "endpoint"), "endpoint": ("assign", "access", "key")}
#: Between two scopes.
BREAK = "\\n[\\x20\\x09\\x0D]*\\n"
_NUMBER = {k: i for i, k in enumerate(KINDS)}
_BREAK = len(KINDS)
_PARTS = "array<struct<kind:int,i:int,before:int,own:int,value:int>>"


def _matches(text: Column, pattern: str, number: int) -> Column:
    """Matches as structs: kind, place, length of what is between the one before and this, own length, and the length of the value."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if number == _NUMBER["assign"] else found
    zipped = F.arrays_zip(F.slice(F.split(text, pattern), 1, F.size(found)).alias("b"), found.alias("m"), values.alias("v"))
    part = lambda x, i: F.struct(F.lit(number).alias("kind"), i.alias("i"), F.length(x["b"]).alias("before"), F.length(x["m"]).alias("own"), F.length(x["v"]).alias("value"))
    return F.when(text.rlike(pattern), F.transform(zipped, part)).otherwise(F.array().cast(_PARTS))


def find_secrets(docs: DataFrame, reach: int = REACH, carry: list[str] | None = None) -> DataFrame:
    """The carried columns of docs (all, by default) with ``spans``: array of (start, kind, end), code points, end exclusive,
    by begin and then in the order of KINDS. docs: text and anything else."""
    carried = [c for c in (docs.columns if carry is None else carry) if c.lower() != "spans"]
    row, parts_, whole = free_name(docs, "row"), free_name(docs, "parts"), free_name(docs, "whole")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kinds = [_matches(text, p, _NUMBER[k]) for k, p in KINDS.items()]
    rows = docs.select(*carried, F.monotonically_increasing_id().alias(row), F.concat(*kinds).alias(parts_), text.alias(whole))
    weak = F.exists(parts_, lambda x: x["kind"] >= len(BASE)) & F.exists(parts_, lambda x: x["kind"] != _NUMBER["id"])
    breaks = F.when(weak, _matches(F.col(whole), BREAK, _BREAK)).otherwise(F.array().cast(_PARTS))
    found = written(rows.select(*carried, row, F.concat(parts_, breaks).alias(parts_)), "parts")

    # positions, by running sums of each kind's lengths
    at = found.where(F.size(parts_) > 0).select(F.col(row).alias("row"), F.explode(parts_).alias("x")).select("row", "x.*").repartition("row")
    sofar = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("before").cast("long") + F.col("own")).over(sofar)
    at = at.withColumn("end", end).withColumn("start", F.col("end") - F.col("own")).where((F.col("kind") != _NUMBER["assign"]) | (F.col("value") >= ASSIGN_LEAST))

    # scopes, and weak parts under spans that count by themselves
    up = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)  # a frame that only grows
    base = F.col("kind") < len(BASE)
    under = (F.max(F.when(base, F.col("end"))).over(up) > F.col("start")) | (F.min(F.when(base, F.col("start"))).over(down) < F.col("end"))
    at = at.withColumns({"scope": F.count_if(F.col("kind") == _BREAK).over(up), "under": F.coalesce(under, F.lit(False))})
    at = at.where((F.col("kind") != _BREAK) & (base | ~F.col("under")))

    # the nearest complementary part before and after, within the scope
    up = Window.partitionBy("row", "scope").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("row", "scope").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)
    near = F.lit(False)
    for kind, needs in COMPLEMENT.items():
        other = F.col("kind").isin(*[_NUMBER[k] for k in needs])
        before = F.col("start") - F.max(F.when(other, F.col("end"))).over(up) <= reach
        after = F.min(F.when(other, F.col("start"))).over(down) - F.col("end") <= reach
        near = near | ((F.col("kind") == _NUMBER[kind]) & (F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))))
    at = at.withColumn("near", near).where(base | F.col("near"))
    spans = F.array_sort(F.collect_list(F.struct("start", "kind", "end")))
    names = F.array(*map(F.lit, KINDS))
    named = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.get(names, x["kind"]).alias("kind"), x["end"].alias("end")))
    by_row = at.groupBy("row").agg(named.alias("spans_")).withColumnRenamed("row", row)
    none = F.array().cast("array<struct<start:long,kind:string,end:long>>")
    return found.join(by_row, row, "left").select(*carried, F.coalesce("spans_", none).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redacted(docs: DataFrame, reach: int = REACH, mask: str = "*") -> DataFrame:
    """docs with every span's characters masked, one for one, in ``text``; spans stay beside it."""
    found = find_secrets(docs, reach)
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def step(acc: Column, x: Column) -> Column:
        start = F.greatest(acc["at"], x["start"])
        kept = F.substring(text, (acc["at"] + 1).cast("int"), (start - acc["at"]).cast("int"))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], kept, F.repeat(F.lit(mask), F.greatest(x["end"] - start, F.lit(0)).cast("int"))).alias("out"))

    masked = F.aggregate("spans", begin, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), 2147483647)))
    return found.withColumn("text", F.when(F.col("text").isNotNull(), masked))
