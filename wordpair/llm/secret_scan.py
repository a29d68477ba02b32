"""Secrets in texts, with credentials whose parts are linked (built-in functions only).

Base kinds are reported wherever they match: ``assign`` (a named secret with a
value of 8 characters or more), ``access`` (an access identifier) and ``hex`` (a
long hexadecimal string).  Weak kinds are reported only as parts of a credential:
``ident`` (a named user or client), ``key`` (a long mixed string without a name,
or a named secret of 4 to 7 characters) and ``endpoint`` (a URL of a service).

* One scan of the text decides by one pattern whether a row can hold anything; only
  then the kinds' matches are taken.  A match's place is the sum of the lengths of
  what ``split`` leaves between the matches before it, so no position is guessed.
* Parts are joined to scopes by a sweep: in order of place, a new scope begins
  after a blank line or after ``reach`` characters without a part.  A scope is an
  interval of one text, and every part falls in exactly one.
* A scope with an identifier (``access`` or ``ident``) and a secret (``assign``,
  ``hex`` or ``key``) is a credential.  Its weak parts are reported, all others go.

The sweep's windows and the last aggregate have one text as their group; nothing
else is shuffled, and texts without a part never are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordpair.llm.store import written

#: Names of secrets, as their pattern lists them.
NAMES = "password|passwd|secret|token|api_?key"
_QUOTE = "[\"']?"
_EQUALS = _QUOTE + r"\x20*[:=]\x20*" + _QUOTE

#: kind -> (pattern, fewest characters, group whose characters count)
BASE = {
    "assign": (rf"(?i)({NAMES}){_EQUALS}([A-Za-z0-9+/_.=-]+)", 8, 2),
    "access": (r"AKIA[A-Z0-9]+", 16, 0),
    # runs of hexadecimal digits are maximal, so the shortest length can stand in the pattern
    "hex": (r"[0-9a-f]{32,}", 32, 0),
}
WEAK = {
    "ident": (rf"(?i)(user_?name|user|login|account|client_?id|access_?key_?id){_EQUALS}([A-Za-z0-9@_.-]+)", 3, 2),
    "key": (r"[A-Za-z0-9+/]{40,}={0,2}", 40, 0),
    "endpoint": (r"(?i)(https?|jdbc:[a-z0-9]+|postgres|postgresql|mysql|mongodb|redis|amqps?|s3)://"
                 r"[^\x20\x09-\x0D\"'<>]+", 10, 0),
}
KINDS = [*BASE, "short", *WEAK]
_IDENTIFIERS, _SECRETS = ("access", "ident"), ("assign", "hex", "key")
#: A row without this holds neither a base part nor, alone, a secret.
TRIGGER = rf"(?i:{NAMES}){_EQUALS}[A-Za-z0-9+/_.=-]|AKIA[A-Z0-9]|[0-9a-f]{{32}}|[A-Za-z0-9+/]{{40}}"
BLANK_LINE = r"\n[\x20\t\r]*\n"


def _matches(text: Column, pattern: str, group: int) -> Column:
    """Matches, their counting group and the lengths between them."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.struct(whole.alias("whole"),
                    (F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole).alias("counts"),
                    F.transform(F.split(text, pattern, -1), F.length).alias("between"))


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``uid, doc_id, parts``: for rows that can hold something, the matches of
    each kind; ``parts`` is null for all others."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = {**{k: (p, g) for k, (p, _, g) in {**BASE, **WEAK}.items()}, "blank": (BLANK_LINE, 0)}
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    parts = F.struct(*[_matches(F.col("text"), p, g).alias(k) for k, (p, g) in kinds.items()])
    return rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id",
                       F.when(F.col("text").rlike(TRIGGER), parts).alias("parts"))


def _placed(found: DataFrame, kind: str) -> DataFrame:
    """``uid, kind, start, end, value, counts`` of every match of a kind."""
    m = F.col("parts")[kind]
    one = found.where(F.size(m["whole"]) > 0).select(
        "uid", F.posexplode(F.arrays_zip(m["whole"].alias("whole"), m["counts"].alias("counts"),
                                         F.slice(m["between"], 1, F.size(m["whole"])).alias("before")))
        .alias("nth", "m"))
    one = one.select("uid", "nth", "m.*").withColumn("length", F.length("whole"))
    upto = Window.partitionBy("uid").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum((F.col("before") + F.col("length")).cast("long")).over(upto)
    return one.select("uid", F.lit(kind).alias("kind"), (end - F.col("length")).alias("start"),
                      end.alias("end"), F.col("whole").alias("value"), "counts")


def _candidates(found: DataFrame) -> DataFrame:
    """Base parts, weak candidates and blank lines with their places.

    Matches that are too short go, but they have taken their characters: the next
    match is looked for behind them.  A named secret of 4 to 7 characters is a weak
    one (``short``, reported as ``key``)."""
    out = None
    for kind in [*BASE, *WEAK, "blank"]:
        at = _placed(found, kind)
        least = {**BASE, **WEAK}.get(kind, ("", 0, 0))[1]
        if kind == "assign":
            n = F.length("counts")
            at = (at.where(n >= 4)
                  .withColumn("kind", F.when(n >= least, F.lit("assign")).otherwise(F.lit("short"))))
        else:
            at = at.where(F.length("counts") >= least)
        if kind == "key":
            at = at.where(F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]"))
        out = at if out is None else out.unionByName(at)
    return out


def _spans(found: DataFrame, reach: int) -> DataFrame:
    """``uid, kind, start, end, scope, linked``: base parts, and the weak parts of
    credentials."""
    at = _candidates(found).select("uid", "kind", "start", "end")
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    order = [F.col("start"), rank, F.col("end")]
    base = F.col("kind").isin(*BASE)
    before = Window.partitionBy("uid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("uid").orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    # a weak candidate that overlaps a base part says nothing new
    over = (F.max(F.when(base, F.col("end"))).over(before) > F.col("start"))
    under = (F.min(F.when(base, F.col("start"))).over(after) < F.col("end"))
    at = (at.withColumn("covered", F.coalesce(over, F.lit(False)) | F.coalesce(under, F.lit(False)))
          .where(base | ~F.col("covered"))
          .withColumn("kind", F.when(F.col("kind") == "short", F.lit("key")).otherwise(F.col("kind"))))
    blank = F.col("kind") == "blank"
    last_end = F.max(F.when(~blank, F.col("end"))).over(before)
    opens = blank | F.coalesce(F.col("start") - last_end > reach, F.lit(False))
    at = at.withColumn("opens", opens.cast("long"))
    at = at.withColumn("scope", F.sum("opens").over(
        Window.partitionBy("uid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    in_scope = Window.partitionBy("uid", "scope")
    linked = (F.max(F.col("kind").isin(*_IDENTIFIERS)).over(in_scope)
              & F.max(F.col("kind").isin(*_SECRETS)).over(in_scope))
    at = at.where(~blank).withColumn("linked", linked)
    return at.where(F.col("kind").isin(*BASE) | F.col("linked"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 reach: int = 200) -> DataFrame:
    """One row per input row: ``doc_id, spans`` with ``spans`` an array of
    ``(start, end, kind, scope, linked)`` in order of start, then kind.

    Places are code points, ends exclusive.  ``linked`` says that the span's scope
    holds an identifier and a secret.  A null text counts as empty; texts without
    a secret have an empty array.  Rows that repeat an id, or have none, get a row
    each.  An empty table gives no rows.  Other columns are ignored.
    """
    found = written(_found(docs, id_col, text_col), "secrets")
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    some = _spans(found.where("parts is not null").select("uid", "parts"), reach)
    some = (some.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct(
        "start", rank.alias("rank"), "end", "kind", "scope", "linked"))).alias("spans")))
    held = found.where("parts is not null").select("uid", "doc_id").join(some, "uid", "left")
    free = found.where("parts is null").select(
        "doc_id", F.lit(None).cast(some.schema["spans"].dataType).alias("spans"))
    out = held.select("doc_id", "spans").unionByName(free)
    return out.select("doc_id", F.transform(F.coalesce("spans", F.array()), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"),
        s["scope"].alias("scope"), s["linked"].alias("linked"))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as text."""
    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def only(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    return found.select("doc_id", *[F.size(only(k)).cast("long").alias(f"n_{k}") for k in BASE],
                        F.sha2(text(only(*BASE)), 256).alias("base_sha256"),
                        text(F.col("spans")).alias("spans"))
