"""Rules, weighted scores, and what explains them. A score is one expression for each row: no step shuffles until rows are ordered."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import haversine_km
from ..model import RUBRIC, Rubric, Scaled
from ..session import per_session
from .criteria import area_key, classify


def signal(magnitude: Column, fired: Column | None = None, confidence: float = 1.0) -> Column:
    """Null magnitude: no signal."""
    return F.when(magnitude.isNotNull(), F.struct((fired if fired is not None else F.lit(True)).alias("fired"), magnitude.cast("double").alias("magnitude"), F.lit(confidence).alias("confidence")))


def _one(fact: Column) -> Column:
    return F.when(fact, F.lit(1.0))


@dataclass(frozen=True)
class Rule:
    """detector: () -> signal; shape: magnitude -> magnitude."""

    key: str
    category: str
    label: str
    detector: Callable[[Rubric], Column]
    shape: Callable[[Column], Column] = lambda m: m


REGISTRY: dict[str, Rule] = {}


def rule(key: str, category: str, label: str, shape: Callable[[Column], Column] = lambda m: m):
    """Register a detector; a key can't be taken twice."""

    def put(f: Callable[[Rubric], Column]) -> Callable[[Rubric], Column]:
        if key in REGISTRY:
            raise ValueError(f"rule {key} is registered already")
        REGISTRY[key] = Rule(key, category, label, f, shape)
        return f

    return put


def _fact(name: str) -> Column:
    return F.col(f"facts.{name}")


def _floor() -> Column:
    """The source's own, else what the text says."""
    return F.coalesce(F.col("floor"), _fact("floor").cast("double"))


rule("laundry.in_suite", "amenities", "In-suite laundry")(lambda r: signal(_one(_fact("in_suite_laundry")), confidence=0.6))
rule("laundry.building", "amenities", "Building laundry")(lambda r: signal(_one(_fact("building_laundry")), confidence=0.6))
rule("floor.low", "space", "Low floor", shape=lambda m: 1 / (1 + (m - 1) / F.lit(3.0)))(lambda r: signal(F.when(_floor() >= 1, _floor())))
rule("walk.score", "proximity", "Walk score")(lambda r: signal(_fact("walk_score"), confidence=0.6))
rule("space.den_or_solarium", "space", "Den or solarium")(lambda r: signal(_one(_fact("den")), confidence=0.6))
rule("amenities.gym_building", "amenities", "Gym in the building")(lambda r: signal(_one(_fact("gym")), confidence=0.6))
rule("proximity.gym_nearby", "proximity", "Gym nearby")(lambda r: signal(_one(_fact("gym_near")), confidence=0.6))
rule("proximity.grocery_nearby", "proximity", "Grocery nearby")(lambda r: signal(_one(_fact("grocery_near")), confidence=0.6))
rule("density.walkable", "proximity", "Walkable")(lambda r: signal(_one(_fact("density") == "walkable"), confidence=0.6))
rule("density.sparse", "proximity", "Sparse")(lambda r: signal(_one(_fact("density") == "sparse"), confidence=0.6))
rule("parking.available", "amenities", "Parking")(lambda r: signal(F.when(_fact("parking").isNotNull(), (_fact("parking") != "Unavailable").cast("double")), confidence=0.6))
rule("pets.allowed", "amenities", "Pets")(lambda r: signal(F.when(_fact("pets") == "friendly", 1.0).when(_fact("pets") == "conditional", 0.5).when(_fact("pets") == "no_pets", 0.0), confidence=0.6))
rule("area.over_minimum", "space", "Area over the minimum")(lambda r: signal(F.when((F.lower("area_unit") == r.area_unit) & (F.col("area") > (r.area_min or 0)), F.col("area") - (r.area_min or 0.0))))
rule("rent.headroom", "cost", "Rent headroom")(lambda r: signal(F.when((F.col("currency") == r.currency) & (F.col("rent") < (r.rent_max or 0)), (r.rent_max or 0.0) - F.col("rent"))))
rule("photo.present", "evidence", "Photos")(lambda r: signal(_one(F.col("photos") > 0)))


def enabled(weights: dict[str, float | Scaled]) -> dict[str, float | Scaled]:
    """Weights that count; one of a rule that isn't registered is an error."""
    out = {k: w for k, w in weights.items() if (w.rate and w.cap if isinstance(w, Scaled) else w)}
    if unknown := set(out) - set(REGISTRY):
        raise KeyError(f"no rule for {sorted(unknown)}")
    return out


def possible(weight: float | Scaled) -> tuple[float, float]:
    """The least and the most that a weight can contribute."""
    if isinstance(weight, Scaled):
        cap = abs(weight.cap)
        return (0.0, cap) if weight.rate >= 0 else (-cap, 0.0)
    return min(weight, 0.0), max(weight, 0.0)


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def contribution(weight: float | Scaled, s: Column, shape: Callable[[Column], Column]) -> Column:
    shaped, confidence = shape(s.magnitude), clamp(s.confidence, 0.0, 1.0)
    if isinstance(weight, Scaled):
        cap = abs(weight.cap)
        amount = clamp(F.greatest(shaped, F.lit(0.0)) / 100.0 * weight.rate, -cap, cap) * confidence
    else:
        amount = weight * clamp(shaped, 0.0, 1.0) * confidence
    return F.when(s.isNotNull() & s.fired, amount).otherwise(F.lit(0.0))


TERM = "struct<rule_key:string,category:string,label:string,min_possible:double,max_possible:double,contribution:double>"


def _term(key: str, category: str, label: str, lo: float, hi: float, amount: Column) -> Column:
    return F.struct(F.lit(key).alias("rule_key"), F.lit(category).alias("category"), F.lit(label).alias("label"), F.lit(float(lo)).alias("min_possible"), F.lit(float(hi)).alias("max_possible"), amount.alias("contribution"))


@per_session
def terms(r: Rubric) -> tuple[list[Column], float, float]:
    """Every term of a score, and the least and the most that they add up to."""
    out, lo, hi = [], 0.0, 0.0
    for key, weight in enabled(r.weights).items():
        x, (a, b) = REGISTRY[key], possible(weight)
        out.append(_term(key, x.category, x.label, a, b, contribution(weight, x.detector(r), x.shape)))
        lo, hi = lo + a, hi + b
    if r.area_key_weights:
        a, b = min(0.0, *r.area_key_weights.values()), max(0.0, *r.area_key_weights.values())
        weights = F.create_map(*(F.lit(v) for kv in r.area_key_weights.items() for v in kv))
        out.append(_term("location.area_key", "proximity", "Area preference", a, b, F.coalesce(F.element_at(weights, area_key()), F.lit(0.0))))
        lo, hi = lo + a, hi + b
    if r.landmark is not None and r.landmark.weight:
        m = r.landmark
        near = F.greatest(F.lit(0.0), 1 - haversine_km(F.col("lat"), F.col("lng"), F.lit(m.lat), F.lit(m.lng)) / m.within_km)
        out.append(_term("landmark.distance", "proximity", f"Near {m.name}", 0.0, m.weight, m.weight * F.coalesce(near, F.lit(0.0))))
        hi += m.weight
    if r.unverified_penalty > 0:
        out.append(_term("confidence.unverified", "amenities", "Missing criteria facts", -r.unverified_penalty, 0.0, F.when(F.col("status") == "unverified", -r.unverified_penalty).otherwise(0.0)))
        lo -= r.unverified_penalty
    return out, lo, hi


@per_session
def _breakdown(r: Rubric) -> Column:
    return F.array(*terms(r)[0]).cast(f"array<{TERM}>")


def score(listings: DataFrame, r: Rubric = RUBRIC) -> DataFrame:
    """Classified listings with breakdown (an array of terms), total, and score (0 to 100; without any span 100)."""
    _, lo, hi = terms(r)
    out = classify(listings, r).withColumn("breakdown", _breakdown(r))
    out = out.withColumn("total", F.aggregate("breakdown", F.lit(0.0), lambda a, t: a + t.contribution))
    return out.withColumn("score", F.lit(100.0) if hi == lo else clamp(100.0 * (F.col("total") - lo) / (hi - lo), 0.0, 100.0))


def ranked(scored: DataFrame, limit: int | None = None) -> DataFrame:
    """The eligible listings, the best first. With a limit they are chosen before they are filtered, so no optimizer reads the texts twice."""
    if not limit:
        return scored.filter("eligible").orderBy(F.desc("score"), "listing_id")
    return scored.orderBy(F.desc("eligible"), F.desc("score"), "listing_id").limit(limit).filter("eligible")


def rescored(listings: DataFrame, r: Rubric = RUBRIC) -> DataFrame:
    """listing_id, score of the eligible listings, the best first: what takes the place of all scores of a rubric that has changed."""
    return ranked(score(listings, r)).select("listing_id", "score")


def category_rollup(scored: DataFrame) -> DataFrame:
    """For each listing and category: contributions, what was possible, and their share in hundredths. A listing's terms are
    all in its row, so they are summed up there and nothing is shuffled."""
    names = F.array_distinct(F.transform("breakdown", lambda t: t.category))

    def total(c: Column) -> Column:
        own = lambda f: F.aggregate(F.filter("breakdown", lambda t: t.category == c), F.lit(0.0), lambda a, t: a + f(t))
        return F.struct(c.alias("category"), own(lambda t: t.contribution).alias("score"), own(lambda t: t.max_possible).alias("max_score"))

    g = scored.select("listing_id", F.explode(F.transform(names, total)).alias("g")).select("listing_id", "g.category", "g.score", "g.max_score")
    return g.withColumn("pct", F.when(F.col("max_score") > 0, clamp(100 * F.col("score") / F.col("max_score"), 0.0, 100.0)).otherwise(F.lit(0.0)))


def top_contributors(scored: DataFrame, n: int = 3) -> DataFrame:
    """The n terms of the largest size, without those that add nothing; ties keep the order of the terms."""
    placed = F.transform("breakdown", lambda t, i: F.struct((-F.abs(t.contribution)).alias("by"), i.alias("i"), t.rule_key.alias("rule_key"), t.contribution.alias("contribution")))
    top = F.slice(F.array_sort(F.filter(placed, lambda t: t.contribution != 0)), 1, n)
    return scored.select("listing_id", F.posexplode(top).alias("place", "t")).select("listing_id", (F.col("place") + 1).alias("place"), "t.rule_key", "t.contribution")


def explanation(scored: DataFrame) -> DataFrame:
    """What helped, what hurt and what made no difference, as texts."""
    def part(keep: Callable[[Column], Column], by: Callable[[Column], Column]) -> Column:
        some = F.transform(F.filter("breakdown", keep), lambda t: F.struct(by(t).alias("by"), t.label.alias("label")))
        return F.array_join(F.transform(F.array_sort(some), lambda t: t.label), ", ")

    return scored.select(
        "listing_id",
        part(lambda t: t.contribution > 0, lambda t: -t.contribution).alias("helped"),
        part(lambda t: t.contribution < 0, lambda t: t.contribution).alias("hurt"),
        part(lambda t: t.contribution == 0, lambda t: t.label).alias("neutral"),
    )


def rubric_diff(listings: DataFrame, before: Rubric, after: Rubric) -> DataFrame:
    """listing_id and change (entered, left) between two rubrics over the same listings. One pass: both verdicts are columns of a row, so nothing is joined."""
    one = classify(listings, before).select(*listings.columns, "facts", F.col("eligible").alias("was"))
    both = classify(one, after).select("listing_id", "was", F.col("eligible").alias("is"))
    return both.filter("was <> is").select("listing_id", F.when(F.col("is"), "entered").otherwise("left").alias("change"))


def best_per_listing(scores: DataFrame, n: int) -> DataFrame:
    """The best score of each listing, then the n best listings."""
    best = scores.groupBy("listing_id").agg(F.max("score").alias("score"))
    return best.orderBy(F.desc("score"), "listing_id").limit(n)


def with_rank(df: DataFrame, *by: Column) -> DataFrame:
    """Number all rows; one task orders them, so only for what is cut to a page before."""
    return df.withColumn("place", F.row_number().over(Window.orderBy(*by)))
