"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Base patterns find e-mail addresses, IP addresses, card and phone numbers; matches that
fail their check are dropped.  The texts found are the seed entities.  What stands around an
entity, its last one and two words before and its first one and two after, are lexical
patterns.  Candidates for other entities are tokens with digits, groups of digits between
single blanks, dots, slashes, hyphens and brackets, and addresses written with "(at)".
Patterns and entities form a graph, in which Spark scores them in turns:

* a pattern's confidence for a kind is the share of known entities of that kind among all
  it extracts; unknown candidates whose form allows that kind (``fitting``) are left out of
  this count, others count against it; it counts from ``MIN_SUPPORT`` different known
  entities and ``MIN_CONFIDENCE`` on;
* an unknown candidate's score for a kind is 1 - product(1 - confidence) over such patterns;
  from ``MIN_SCORE`` on it is an entity of that kind and a seed of the next turn.

After ``TURNS`` turns every occurrence of a discovered entity that overlaps no base span is a
span too.  Positions are code points, ends exclusive.

Each kind's matches and the lengths of what stands between them give positions by running
sums, so a text is never shuffled.  Regular expressions are possessive and anchored at the
ends of runs, so a long run is read once and without recursion.  Graph counts are partial
sums over distinct edges; a pattern such as an article may hold a third of the edges.

Null and empty texts have no spans; repeated rows are judged one by one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.common import cut

KINDS = ["email", "ip", "card", "phone"]
TOKEN = "token"
FORM = "form"
SPELT = "spelt"
CANDIDATES = [TOKEN, FORM, SPELT]
TURNS = 3
MIN_SUPPORT = 5
MIN_CONFIDENCE = 0.7
MIN_SCORE = 0.8
#: Characters before and after a match in which its one or two words of context are looked for.
CONTEXT = 64

_LOCAL = "[A-Za-z0-9._%+-]"
#: A match starts where the class's run starts or where the last match ended: elsewhere it would fail as well.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # Other identifiers: six or more letters, digits, hyphens or underlines with a digit.
    TOKEN: r"(?<![\p{L}\p{N}_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{6,}+",
    # Groups of digits, six characters or more in all, with one separator between two of them.
    FORM: r"(?<![\p{L}\p{N}_+-])(?=[0-9(][0-9()\x20./-]{5})\(?+[0-9]++\)?+(?:[\x20./-]?+\(?+[0-9]++\)?+)++",
    SPELT: rf"(?<!{_LOCAL}){_LOCAL}++\x20?+[(\[{{]\x20?+(?i:at)\x20?+[)\]}}]\x20?+[A-Za-z0-9-]++(?:(?:\.|\x20?+[(\[{{]\x20?+(?i:dot)\x20?+[)\]}}]\x20?+)[A-Za-z0-9-]++)*+",
}
#: A text without this has no match.
_NEEDS = {"email": "%@%.%", "ip": "%.%.%.%", "card": "%", "phone": "%+%", TOKEN: "%", FORM: "%"}


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def valid(kind: Column, match: Column) -> Column:
    """The check of each kind."""
    digits = _digits(match)
    n = F.length(digits)
    small = F.forall(
        F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "")),
        lambda p: (F.length(p) <= 3) & (p.try_cast("int") <= 255),
    )
    return (
        F.when(kind == "ip", small)
        .when(kind == "card", n.between(16, 19) & F.call_function("luhn_check", digits))
        .when(kind == "phone", n.between(8, 15))
        .otherwise(True)
    )


def _matches_of(kind: str, text: Column) -> Column:
    """Array of (kind, place, gap, match, before): the gap is the length of what precedes the match."""
    pattern = F.lit(PATTERNS[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, PATTERNS[kind], -1)
    rows = F.transform(
        found,
        lambda m, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("place"), F.length(F.get(between, i)).alias("gap"), m.alias("match"),
            F.right(F.get(between, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(between, i + 1), F.lit(CONTEXT)).alias("after"),
        ),
    )
    none = F.array().cast("array<struct<kind:string,place:int,gap:int,match:string,before:string,after:string>>")
    possible = text.rlike("[0-9]") if _NEEDS.get(kind) == "%" else text.like(_NEEDS[kind]) if kind in _NEEDS else text.rlike(r"(?i)[(\[{] ?at ?[)\]}]")
    if kind == "card":
        possible = text.rlike("[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]")
    return F.when(possible, rows).otherwise(none)


def _scan(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per document with all matches; written once."""
    body = F.coalesce(F.col(text), F.lit(""))
    every = [_matches_of(k, F.col("_text")) for k in (*KINDS, *CANDIDATES)]
    rows = docs.select(F.col(key).alias("_id"), F.monotonically_increasing_id().alias("row"), F.xxhash64(body).alias("hash"), body.alias("_text"))
    return cut(rows.select("_id", "row", "hash", F.concat(*every).alias("found")))


def _placed(scanned: DataFrame) -> DataFrame:
    """Valid base matches and candidates that overlap none of them: row, kind, start, end, match, before, after."""
    each = scanned.select("row", F.explode("found").alias("f")).select("row", "f.*")
    earlier = Window.partitionBy("row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("gap") + F.length("match")).over(earlier), F.lit(0)) + F.col("gap")
    each = each.withColumn("start", start.cast("long")).withColumn("end", (start + F.length("match")).cast("long"))
    each = each.filter(valid(F.col("kind"), F.col("match")))
    base = F.col("kind").isin(KINDS)
    order = Window.partitionBy("row").orderBy("start", "end", "kind")
    ahead = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    clear = (F.coalesce(ahead, F.lit(0)) <= F.col("start")) & (F.coalesce(behind, F.col("end")) >= F.col("end"))
    each = each.withColumn("clear", clear).filter(base | F.col("clear"))
    return cut(each.select("row", "kind", "start", "end", F.lower("match").alias("entity"), "before", "after"))


def fitting(entity: Column) -> Column:
    """The kinds that a candidate's form allows."""
    digits = _digits(entity)
    n = F.length(digits)
    plain = entity.rlike(r"^[0-9()\x20./-]+$")
    allowed = {
        "email": entity.rlike(r"[(\[{]\x20?at\x20?[)\]}]"),
        "ip": entity.rlike(r"^[0-9]{1,3}([./\x20-][0-9]{1,3}){3}$"),
        "card": plain & n.between(16, 19) & F.call_function("luhn_check", digits),
        "phone": plain & n.between(8, 15),
    }
    return F.filter(F.array(*[F.when(allowed[k], k) for k in KINDS]), lambda k: k.isNotNull())


def _edges(placed: DataFrame) -> DataFrame:
    """Distinct (pattern, entity, kind): kind is null for candidates that no base pattern matches."""
    gap = r"[^\p{L}\p{N}]{1,3}"
    words = [
        F.regexp_extract("before", rf"(\p{{L}}+){gap}$", 1), F.regexp_extract("before", rf"(\p{{L}}+{gap}\p{{L}}+){gap}$", 1),
        F.regexp_extract("after", rf"^{gap}(\p{{L}}+)", 1), F.regexp_extract("after", rf"^{gap}(\p{{L}}+{gap}\p{{L}}+)", 1),
    ]
    named = [F.when(w != "", F.concat(F.lit("> " if i > 1 else ""), F.regexp_replace(w, r"[^\p{L}]+", " "))) for i, w in enumerate(words)]
    patterns = F.array_distinct(F.filter(F.array(*named), lambda p: p.isNotNull()))
    kind = F.when(F.col("kind").isin(KINDS), F.col("kind"))
    return cut(placed.select(F.explode(patterns).alias("pattern"), "entity", kind.alias("kind")).withColumn("pattern", F.lower("pattern")).distinct())


def discover(
    edges: DataFrame, turns: int = TURNS, support: int = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE, score: float = MIN_SCORE
) -> DataFrame:
    """(entity, kind, score) of the entities that patterns reveal, by turns over the pattern-entity graph."""
    seeds = edges.filter("kind is not null").select("entity", "kind").distinct()
    found = None
    totals = cut(edges.groupBy("pattern").agg(F.countDistinct("entity").alias("n")))
    unknown = edges.filter("kind is null").select("pattern", "entity")
    for _ in range(turns):
        known = seeds if found is None else seeds.unionByName(found.select("entity", "kind")).distinct()
        hits = edges.select("pattern", "entity").distinct().join(known, "entity").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("hits"))
        open_ = unknown.join(known.select("entity").distinct(), "entity", "left_anti")
        neutral = open_.select("pattern", F.explode(fitting(F.col("entity"))).alias("kind")).groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("fit"))
        strong = (
            hits.filter(F.col("hits") >= support).join(totals, "pattern").join(neutral, ["pattern", "kind"], "left")
            .withColumn("confidence", F.col("hits") / (F.col("n") - F.coalesce("fit", F.lit(0)))).filter(F.col("confidence") >= confidence)
            .select("pattern", "kind", F.least("confidence", F.lit(0.999)).alias("confidence"))
        )
        strong = cut(strong)
        scored = unknown.join(strong, "pattern").groupBy("entity", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score"))
        scored = scored.filter(F.col("score") >= score)
        # One kind per entity: the best scored, ties by name.
        best = scored.groupBy("entity").agg(F.min(F.struct((-F.col("score")).alias("s"), "kind")).alias("b"))
        found = cut(best.select("entity", F.col("b.kind").alias("kind"), (-F.col("b.s")).alias("score")))
    return found


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: the key, ``hash`` (of its text) and ``spans``, an array of (kind, start, end, base)
    in order of kind as listed, then place."""
    scanned = _scan(docs, key, text)
    placed = _placed(scanned)
    revealed = discover(_edges(placed)).select("entity", F.col("kind").alias("revealed"))
    base = placed.filter(F.col("kind").isin(KINDS)).select("row", "kind", "start", "end", F.lit(True).alias("base"))
    added = (
        placed.filter(~F.col("kind").isin(KINDS)).join(revealed, "entity")
        .select("row", F.col("revealed").alias("kind"), "start", "end", F.lit(False).alias("base"))
    )
    rank = reduce(lambda c, i: c.when(F.col("kind") == KINDS[i], i), range(1, len(KINDS)), F.when(F.col("kind") == KINDS[0], 0))
    every = base.unionByName(added).groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct(rank.alias("rank"), "start", "end", "kind", "base"))).alias("s")
    )
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")
    plain = F.transform("s", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base")))
    return scanned.select("_id", "row", "hash").join(every, "row", "left").select(
        F.col("_id").alias(key), "hash", F.coalesce(plain, none).alias("spans")
    )


def written(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with each span of its texts replaced by its kind in square brackets; of overlapping
    spans the parts are joined under the first one's kind."""
    body = F.coalesce(F.col(text), F.lit(""))
    found = spans(docs, key, text).filter(F.size("spans") > 0)
    by_place = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")
    merged = F.aggregate(
        by_place, empty,
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] > x["start"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"), F.element_at(acc, -1)["kind"].alias("kind"))),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    marks = cut(found.groupBy(F.col(key).alias("_pii_key"), F.col("hash").alias("_pii_hash")).agg(F.first("spans").alias("spans")).select("_pii_key", "_pii_hash", merged.alias("_pii_marks")))
    names = docs.columns
    whole = docs.withColumn("_pii_h", F.xxhash64(body)).join(
        marks, F.col(f"`{key}`").eqNullSafe(F.col("_pii_key")) & (F.col("_pii_h") == F.col("_pii_hash")), "left"
    )
    before = F.transform(
        "_pii_marks",
        lambda x, i: F.concat(
            F.substring(
                F.col(text),
                (F.when(i > 0, F.get("_pii_marks", i - 1)["end"]).otherwise(0) + 1).cast("int"),
                (x["start"] - F.when(i > 0, F.get("_pii_marks", i - 1)["end"]).otherwise(0)).cast("int"),
            ),
            F.lit("["), F.upper(x["kind"]), F.lit("]"),
        ),
    )
    rest = F.substring(F.col(text), (F.element_at("_pii_marks", -1)["end"] + 1).cast("int"), F.length(text))
    clean = F.when(F.size("_pii_marks") > 0, F.concat(F.array_join(before, ""), rest)).otherwise(F.col(text))
    return whole.select(*[clean.alias(c) if c == text else F.col(f"`{c}`") for c in names])
