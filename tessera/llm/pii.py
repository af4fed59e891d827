"""Personal data by bootstrapped contextual extraction.

Base rules find seed entities. The words around the seeds induce lexical
patterns; patterns and instances form a bipartite graph that is scored in
rounds: a pattern is as good as the instances it finds are, an instance as good
as the patterns that find it. Patterns of high confidence discover identifiers
that no rule knows, which induce patterns in turn. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh
from .spans import Rule, joined, spans, tagged


def _digits(v: Column) -> Column:
    return F.length(F.regexp_replace(v, "[^0-9]", ""))


def _luhn(v: Column) -> Column:
    digits = F.transform(F.split(F.reverse(F.regexp_replace(v, "[^0-9]", "")), ""), lambda d: d.try_cast("int"))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _octets(v: Column) -> Column:
    """All four parts at most 255; leading zeros don't count."""
    return F.forall(F.split(v, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).try_cast("int") <= 255))


# The base rules, in their order.
RULES = (
    Rule("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    Rule("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", keep=_octets),
    Rule("card", r"[0-9](?:[\x20-]?[0-9])++", keep=lambda v: _digits(v).between(14, 19) & _luhn(v)),
    Rule("phone", r"\+[0-9][\x20().0-9-]+[0-9]", keep=lambda v: _digits(v).between(10, 15)),
)

#: What may be an unknown identifier: three or more groups of digits with a blank or hyphen between, the first perhaps
#: after two letters; or a token of any length from 6 characters on with four digits at least.
GROUPED = r"[A-Za-z]{0,2}[0-9]{2,5}(?:[\x20-][0-9]{2,5}){2,}+(?:[\x20-][0-9])?+(?![^\x20\x09-\x0D.,;:!?)])"
TOKEN = r"(?=[^\x20\x09-\x0D]{6})(?=(?:[^\x20\x09-\x0D0-9]*+[0-9]){4})[^\x20\x09-\x0D]++"
CANDIDATE = rf"(?<![^\x20\x09-\x0D])(?:{GROUPED}|{TOKEN})"

REACH = 48  # characters of context on each side


def _context(left: Column, right: Column) -> Column:
    """The patterns of a place: its two words before, and its word before with its word after, in lower case letters."""
    word = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}]", ""))
    whole = F.when(F.length(left) < REACH, left).otherwise(F.regexp_replace(left, r"^[^\x20\x09-\x0D]*", ""))  # without a word that was cut
    before = F.filter(F.split(whole, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    after = F.filter(F.split(right, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    one, two, next_ = (word(F.coalesce(F.try_element_at(a, F.lit(i)), F.lit(""))) for a, i in ((before, -1), (before, -2), (after, 1)))
    both = F.array(F.when((one != "") & (two != ""), F.concat(F.lit("l:"), two, F.lit(" "), one)), F.when((one != "") & (next_ != ""), F.concat(F.lit("m:"), one, F.lit(" _ "), next_)))
    return F.filter(both, lambda p: p.isNotNull())


def base_spans(text: Column, context: int = REACH) -> dict[str, Column]:
    return {r.name: spans(text, r.pattern, r.keep, context=context) for r in RULES}


def _sure(seeds: DataFrame, unknown: DataFrame, rounds: int, support: int, confidence: float) -> DataFrame:
    """(value, kind) of the unknown values that patterns of enough different seeds find with ``confidence``."""
    good = cut(seeds.groupBy("kind", "pattern").agg(F.count("*").alias("seeds")).filter(F.col("seeds") >= support), "pii-patterns")
    edges = cut(unknown.join(good, "pattern").select("kind", "pattern", "value", "seeds"), "pii-edges")
    instances = edges.select("kind", "value").distinct().withColumn("score", F.lit(0.0))
    for _ in range(rounds):
        patterns = edges.join(instances, ["kind", "value"]).groupBy("kind", "pattern").agg(((F.first("seeds") + F.sum("score")) / (F.first("seeds") + F.count("*") + 1)).alias("weight"))
        doubt = F.exp(F.sum(F.ln(F.greatest(F.lit(1e-6), 1 - F.col("weight")))))
        instances = cut(edges.join(patterns, ["kind", "pattern"]).groupBy("kind", "value").agg((1 - doubt).alias("score")), "pii-scores")
    return cut(instances.filter(F.col("score") >= confidence).groupBy("value").agg(F.max(F.struct("score", "kind"))["kind"].alias("kind")), "pii-sure")


def extract(df: DataFrame, *, key: str = "doc_id", text: str = "text", passes: int = 2, rounds: int = 3, support: int = 4, confidence: float = 0.8) -> DataFrame:
    """Every row of ``df`` with ``pii``, an array of (start, order, end, kind) by start and kind.

    Kinds are those of RULES, and ``ctx_<kind>`` for identifiers that patterns
    discover. A pattern counts if ``support`` different seeds at least have it;
    a discovered identifier needs a score of ``confidence``, overlaps no base
    span, and is a seed of the next of the ``passes``. Positions are code points. Null and empty texts have no spans.
    Repeated rows stay and get the same spans; an input column ``pii`` is
    replaced; an empty table gives an empty result.
    """
    rows = fresh(df, "pii", "__doc", *[f"__{r.name}" for r in RULES], "__tokens", "__found")
    marked = rows.select(F.struct(F.col(key).cast("string").alias("k"), F.xxhash64(F.lit(6), text).alias("h")).alias("doc"), *[s.alias(n) for n, s in base_spans(F.col(text)).items()], spans(F.col(text), CANDIDATE, context=REACH).alias("tokens"))
    some = F.size("tokens") > 0
    for r in RULES:
        some = some | (F.size(r.name) > 0)
    marked = cut(marked.filter(some), "pii-spans")

    # Seeds: base entities in their contexts. Candidates: tokens that touch no base span.
    def places_of(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(F.lit(kind).alias("kind"), F.lower(s["value"]).alias("value"), _context(s["left"], s["right"]).alias("patterns")))

    each = F.flatten(F.array(*[places_of(r.name) for r in RULES]))
    seeds = marked.select(F.explode(each).alias("s")).select("s.kind", "s.value", F.explode("s.patterns").alias("pattern"))
    taken = F.flatten(F.array(*[F.transform(F.col(r.name), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for r in RULES]))
    free = F.filter("tokens", lambda t: ~F.exists("taken", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    places = marked.withColumn("taken", taken).select("doc", F.explode(free).alias("t")).select("doc", "t.start", "t.end", F.lower("t.value").alias("value"), _context(F.col("t.left"), F.col("t.right")).alias("patterns"))
    places = cut(places, "pii-places")
    unknown = places.select("value", F.explode("patterns").alias("pattern")).distinct()

    # Edges are distinct, so a hot text counts once. What a pass is sure of seeds the patterns of the next.
    seeds, unknown, best = cut(seeds.distinct(), "pii-seeds"), cut(unknown, "pii-unknown"), None
    for _ in range(passes):
        sure = _sure(seeds, unknown, rounds, support, confidence)
        best = sure if best is None else best.unionByName(sure)
        seeds = seeds.unionByName(sure.join(unknown, "value").select("kind", "value", "pattern"))
        unknown = unknown.join(sure, "value", "left_anti")
    rank = (F.array_position(F.array(*[F.lit(r.name) for r in RULES]), F.col("kind")) + F.lit(len(RULES) - 1)).cast("int")
    found = places.join(best, "value").select("doc", F.struct("start", rank.alias("order"), "end", F.concat(F.lit("ctx_"), "kind").alias("kind")).alias("s"))
    found = cut(found.groupBy("doc").agg(F.collect_set("s").alias("__found")), "pii-found")

    base = marked.select("doc", F.concat(*[tagged(F.col(r.name), r.name, i) for i, r in enumerate(RULES)]).alias("__base")).dropDuplicates(["doc"])
    base = cut(base.filter(F.size("__base") > 0).join(found, "doc", "full").select(F.col("doc.k").alias("__k"), F.col("doc.h").alias("__h"), "__base", "__found"), "pii-all")
    out = rows.withColumn("__doc", F.struct(F.col(key).cast("string").alias("k"), F.xxhash64(F.lit(6), text).alias("h"))).alias("d").join(base.alias("b"), (F.col("d.__doc.h") == F.col("b.__h")) & F.col("d.__doc.k").eqNullSafe(F.col("b.__k")), "left")
    nothing = F.array().cast("array<struct<start:bigint,order:int,end:bigint,kind:string>>")
    return out.select(*[F.col(f"d.`{c}`") for c in rows.columns], F.array_sort(F.concat(F.coalesce("__base", nothing), F.coalesce("__found", nothing))).alias("pii"))


def pii_digest(documents: DataFrame) -> DataFrame:
    found = extract(documents.select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["order"] < len(RULES))
    n = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[n(r.name) for r in RULES], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))
