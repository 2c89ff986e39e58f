"""Facts from free text, by rules over its words.

A text is first put into plain words (plain()): lower case, one space between words, hyphens and slashes between words
read as spaces, sentences apart by a full stop. Vocabularies are sets of such words: things, what qualifies them, what
denies or offers them. A rule is a row of slots, each taking a word of a set, once or up to so many times, so it says which
words may stand between a thing and its state, and how many. Denials are one rule for all things: a denial before the
thing, or a state of absence after it. Numbers are read where a unit follows or a label stands before.

All facts of a row are found in one Arrow function (Arrow's own RE2, on whole columns), so texts are read once, and no
optimizer copies the work into the filters and projections above it. A null text states nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import product
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# -- fixed values: the words of listing texts, in their plain form; [a|b|] stands for a or b or nothing -----------------

MONTHS = "jan january feb february mar march apr april may jun june jul july aug august sep sept september oct october nov november dec december".split()
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth".split()
UTILITIES = {"hot water": "hot water", "heat": "heat", "water": "water", "hydro": "hydro", "electricity": "electricity", "electric": "electricity", "gas": "gas", "internet": "internet", "wi fi": "internet", "wifi": "internet", "cable": "cable"}
BED, BATH, LEVEL = "[bed|beds|bedroom|bedrooms|br|bd]", "[bath|baths|bathroom|bathrooms|ba]", "[floor|level|storey|story]"
AVAILABLE, SINCE = "[available|availability|move in|move in date]", "[on|from|as of|]"
TOTAL = "[total monthly cost|total monthly rent|monthly total]"
UNFURNISHED = ["unfurnished", "furnished [:|] [no|false]", "not furnished"]
#: What denies, links, counts and points; what is there, offered or given; homes and buildings.
DENIALS, LINKS, ARTICLES, COUNTS = ["no", "without", "not", "isn't"], ["is", "are", "can be"], ["a", "an", "the", "this", "my"], ["one", "1"]
ABSENT, INCLUDED, OFFERED = ["not available", "not included", "unavailable"], ["included"], ["available", "optional", "rented", "reserved"]
GIVES, HAS, WITHIN = ["include", "includes", "come with", "comes with"], ["has"], ["in", "inside"]
HOMES, BUILDINGS = ["suite", "unit", "apartment", "apt", "home"], ["building", "bldg"]
BASEMENTS, LEVELS_BELOW, STORES, EXTRAS = ["basement", "below grade"], ["lower level", "garden level"], ["storage", "locker", "parking", "stall", "parkade", "garage"], ["optional", "separate"]
BESIDES, MEANT = ["optional", "can be added"], ["is", "used", "reserved", "for"]
STALLS, SPOTS, PORTS = ["parking", "garage", "stall"], ["stall", "space", "spot"], ["car port", "carport"]
OF_STALLS, DEDICATED = ["assigned", "on site", "off street", "underground", "secured", "covered"], ["dedicated"]
LAUNDRY, WASHERS, INITIALS = ["laundry"], ["washer dryer", "washer and dryer", "washer"], ["w d"]
OWN = ["in suite", "in unit", "ensuite", "private", "own"]
SHARED = ["coin", "coin op", "coin operated", "shared", "common area", "common", "building", "on site", "onsite", "central", "communal", "public"]
COINS = ["coin op", "coin operated"]
ROOM_ONLY = ["room for rent", "shared [room|home|house|apartment|unit]", "roommate [wanted|needed]"]
WHOLE_UNIT = ["[entire|full] [apartment|condo|townhome|house|suite|unit]"]
WALKABLE = ["[step|steps] from", "walking distance", "heart of", "in the core", "vibrant", "retail strip", "on the strip", "main street location", "walk to everything"]
SPARSE = ["suburban", "single family", "tree lined street", "primarily residential", "residential area", "cul de sac", "quiet neighborhood", "family neighborhood", "low density"]
PETS_NO = ["no [pet|pets]", "pet free", "[pet|pets] [not allowed|prohibited]"]
PETS_YES = ["pet friendly", "[pet|pets] [allowed|welcome]", "[cat|cats|dog|dogs] [ok|welcome|allowed]"]
PETS_MAYBE = ["[pet|pets] considered", "case by case", "[with|landlord] approval", "pet deposit", "pet restrictions"]
DEN = ["den", "solarium"]
GYM = ["building gym", "fitness [centre|center|room]", "gym in [the|] building"]
GYM_NEAR = ["[close to|near|next to] [a|the|] gym"]
GROCERY_NEAR = ["[close to|near|next to] [a|the|] [grocery|supermarket]"]

# -- the grammar --------------------------------------------------------------------------------------------------------


def phrases(*templates: str) -> list[str]:
    """All phrases that templates stand for, longer ones first."""
    out = set()
    for template in templates:
        slots, rest = [], template
        while "[" in rest:
            before, _, rest = rest.partition("[")
            inside, _, rest = rest.partition("]")
            slots += [[before.strip()], [x.strip() for x in inside.split("|")]]
        out |= {" ".join(x for x in choice if x) for choice in product(*slots, [rest.strip()])}
    return sorted(out, key=lambda p: (-len(p), p))


def any_of(*templates: str) -> str:
    """A pattern for all of these phrases."""
    return "(?:" + "|".join(p.replace(".", r"\.") for p in phrases(*templates)) + ")"


class Slot(NamedTuple):
    """Words of which each may stand there, from least to most times."""

    words: list[str]
    least: int = 1
    most: int = 1


def maybe(words: list[str], most: int = 1) -> Slot:
    return Slot(words, 0, most)


def _choice(words: list[str]) -> str:
    return "(?:" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + ")"


def rule(*slots: Slot | list[str]) -> str:
    """A pattern for words that fill these slots one after the other; the last one is filled once."""
    *before, last = [x if isinstance(x, Slot) else Slot(x) for x in slots]
    return "".join(f"(?:{_choice(x.words)} ){{{x.least},{x.most}}}" for x in before) + _choice(last.words)


def denied(*thing: Slot | list[str], states: list[str] | None = None) -> list[str]:
    """Rules for a thing that isn't there: a denial stands before it, or an absence (or another state that rules it out) after it."""
    return [rule(DENIALS, *thing), rule(*thing, maybe(LINKS), ABSENT + (states or []))]


def _figures_of_length(low: str, high: str) -> list[str]:
    if len(low) == 1:
        return [f"[{low}-{high}]"]
    rest = len(low) - 1
    if low[0] == high[0]:
        return [low[0] + x for x in _figures_of_length(low[1:], high[1:])]
    if low[1:] == "0" * rest and high[1:] == "9" * rest:
        return [f"[{low[0]}-{high[0]}]" + rf"\d{{{rest}}}"]
    cut = high[0] + "0" * rest
    return _figures_of_length(low, str(int(cut) - 1)) + _figures_of_length(cut, high)


def figures(low: int, high: int) -> str:
    """A pattern for the whole numbers from low to high, longer ones first."""
    out: list[str] = []
    for n in range(len(str(high)), len(str(low)) - 1, -1):
        out += _figures_of_length(str(max(low, 10 ** (n - 1))), str(min(high, 10**n - 1)))
    return "(?:" + "|".join(out) + ")"


def amounts(high: int) -> str:
    """Of money: thousands apart by commas, or figures from a hundred up."""
    return rf"{figures(1, 999)}(?:,\d{{3}})+|{figures(100, high)}"


def several(number: str, joints: list[str], unit: str) -> str:
    """Two numbers of one unit: neither is the listing's own."""
    return rf"\b{number} ?{_choice(joints)} ?{number} ?{unit}\b"


_BREAKS = [(r"sq\.?\s*ft\.?|square\s+feet", " sqft "), (r"[✔✓☑]", " ✔ "), ("&", " and "), (r"(\d)\s*[–—]\s*(\d)", r"\1-\2"), ("’", "'")]
_JOINTS = [(r"([^\d\s])\s+[-–—]+\s", r"\1 : "), (r"([^\d\s])[-/–—]+", r"\1 "), (r"[-/–—]+([^\d\s])", r" \1"), (r"[.!?;]+(\s|$)", " . "), (r"([:=])", " : "), (r"\$", " $ "), (r",(\s|$)", " , "), (r"[()\[\]{}\"*|+]", " "), (r"\s+", " ")]


def plain(column: pa.Array) -> pa.Array:
    """Texts in plain words, with a space at both ends."""
    t = pc.utf8_lower(pc.fill_null(column.cast(pa.string()), ""))
    for pattern, by in _BREAKS + _JOINTS:
        t = pc.replace_substring_regex(t, pattern, by)
    return pc.binary_join_element_wise("", pc.utf8_trim_whitespace(t), "", " ")


def _has(t: pa.Array, *templates: str) -> pa.Array:
    return pc.match_substring_regex(t, rf"\b{any_of(*templates)}\b")


def _follows(t: pa.Array, *rules: str) -> pa.Array:
    """Whether a text has words that follow one of these rules."""
    return pc.match_substring_regex(t, rf"\b(?:{'|'.join(rules)})\b")


def _cut(t: pa.Array, *rules: str) -> pa.Array:
    return _without(t, rf"\b(?:{'|'.join(rules)})\b")


def _without(t: pa.Array, pattern: str) -> pa.Array:
    return pc.replace_substring_regex(t, pattern, " ")


def _read(t: pa.Array, pattern: str) -> pa.Array:
    """The group x of the first match, else null."""
    found = pc.struct_field(pc.extract_regex(t, pattern), "x")
    return pc.if_else(pc.equal(found, ""), pa.scalar(None, pa.string()), found)


def _number(texts: pa.Array) -> pa.Array:
    return pc.replace_substring(texts, ",", "").cast(pa.float64())


def _first(*cases: tuple[pa.Array, object]) -> pa.Array:
    """The value of the first case that holds, else null."""
    out = pa.scalar(None, pa.scalar(cases[0][1]).type)
    for when, value in reversed(cases):
        out = pc.if_else(when, pa.scalar(value, out.type), out)
    return out


def _within(n: pa.Array, low: int, high: int) -> pa.Array:
    return pc.if_else(pc.and_(pc.greater_equal(n, low), pc.less_equal(n, high)), n, pa.scalar(None, n.type))


# -- the facts: each from raw and plain texts ---------------------------------------------------------------------------

Fact = Callable[[pa.Array, pa.Array], pa.Array]
KINDS: dict[str, tuple[pa.DataType, str]] = {}
EXTRACTORS: dict[str, Fact] = {}
_SPARK = {pa.bool_(): "boolean", pa.string(): "string", pa.date32(): "date", pa.int32(): "int", pa.float64(): "double"}


def fact(kind: pa.DataType, said: bool = True) -> Callable[[Fact], Fact]:
    """Register a fact; said: one of the listing's own, not a mark that only rules look for."""

    def put(f: Fact) -> Fact:
        KINDS[f.__name__] = kind, _SPARK[kind]
        if said:
            EXTRACTORS[f.__name__] = f
        else:
            MARKS[f.__name__] = f
        return f

    return put


MARKS: dict[str, Fact] = {}


@fact(pa.bool_())
def basement(raw: pa.Array, t: pa.Array) -> pa.Array:
    """True where a basement unit is left after what only mentions one; else null."""
    unit, besides = rule(["basement"], HOMES), _choice(BESIDES)
    t = _without(t, rf"\b{unit}\b[^.]*\b{besides}\b|\b{besides}\b[^.]*\b{unit}\b")
    t = _cut(t, rule(["basement"], maybe(MEANT, 3), STORES), rule(EXTRAS, ["basement"], HOMES), rule(DENIALS, maybe(ARTICLES), ["basement"]))
    return _first((_follows(t, rule(BASEMENTS), rule(LEVELS_BELOW, HOMES)), True))


@fact(pa.string())
def furnishing(raw: pa.Array, t: pa.Array) -> pa.Array:
    return _first((_has(t, *UNFURNISHED), "Unfurnished"), (_has(t, "furnished"), "Furnished"))


@fact(pa.date32())
def available_date(raw: pa.Array, t: pa.Array) -> pa.Array:
    """A labelled ISO date, if there is such a day."""
    day = _read(t, rf"\b{any_of(f'{AVAILABLE} {SINCE}')}(?: :)? (?P<x>\d{{4}}-\d{{2}}-\d{{2}})\b")
    real = pc.strptime(day, format="%Y-%m-%d", unit="s", error_is_null=True)
    return pc.if_else(pc.equal(pc.strftime(real, format="%Y-%m-%d"), day), real, pa.scalar(None, real.type)).cast(pa.date32())


@fact(pa.string())
def available_words(raw: pa.Array, t: pa.Array) -> pa.Array:
    """The wording as it stands, only where no date is given: no year is inferred."""
    some = pc.match_substring_regex(t, rf"\b{any_of(AVAILABLE)}\b")
    texts = pc.if_else(some, raw.cast(pa.string()), pa.scalar(None, pa.string())).to_pylist()
    words = pa.array([x and _wording(x) for x in texts], pa.string())
    return pc.if_else(pc.is_null(available_date(raw, t)), words, pa.scalar(None, pa.string()))


def _wording(text: str) -> str | None:
    """The first words that say from when: a label, what may follow it, and a time or a day of a month."""
    tokens = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+|\d+|[^\w\s]", text)]
    word = lambda i: tokens[i][0] if i < len(tokens) else ""
    for i in range(len(tokens)):
        j = _after_label(word, i)
        if j is None:
            continue
        j += {"on": 1, "from": 1}.get(word(j), 2 if (word(j), word(j + 1)) == ("as", "of") else 0)
        j += word(j) == ":"
        if word(j) in ("now", "immediately"):
            return text[tokens[i][1] : tokens[j][2]]
        end = _after_day(word, j, lambda k: tokens[k - 1][2] < tokens[k][1])
        if end:
            return text[tokens[i][1] : tokens[end - 1][2]]
    return None


def _after_label(word: Callable[[int], str], i: int) -> int | None:
    if word(i) in ("available", "availability"):
        return i + 1
    if word(i) != "move":
        return None
    i += 1 + (word(i + 1) == "-")
    return None if word(i) != "in" else i + 1 + (word(i + 1) == "date")


def _after_day(word: Callable[[int], str], i: int, apart: Callable[[int], bool]) -> int | None:
    """Where a month's name, a day (as an ordinal, it may be) and, apart from it, a year end."""
    if word(i) not in MONTHS:
        return None
    i += 1 + (word(i + 1) == ".")
    if not (word(i).isdecimal() and len(word(i)) <= 2 and apart(i)):
        return None
    i += 1 + (word(i + 1) in ("st", "nd", "rd", "th"))
    year = i + (word(i) == ",")
    return year + 1 if word(year).isdecimal() and len(word(year)) == 4 and apart(year) else i


@fact(pa.int32())
def lease_months(raw: pa.Array, t: pa.Array) -> pa.Array:
    n = _within(_read(t, r"\b(?P<x>\d{1,2}) months? lease\b").cast(pa.int32()), 1, 60)
    return pc.coalesce(n, _first((_has(t, "one year lease"), 12)).cast(pa.int32()))


@fact(pa.string())
def utilities(raw: pa.Array, t: pa.Array) -> pa.Array:
    """`all`, the items in order without repeats, or `unspecified`."""
    item = any_of(*UTILITIES)
    items = rf"(?P<x>{item}(?:(?: ,)?(?: and)? {item})*)"
    said = pc.coalesce(_read(t, rf"\b{items} {any_of('[is|are|]')} ?included\b"), _read(t, rf"\b{any_of('[utilities|rent] [include|includes]')} {items}\b"))
    named = {x: ",".join(dict.fromkeys(UTILITIES[i] for i in _items(x))) for x in pc.unique(said).to_pylist() if x}
    listed = pa.array([named.get(x) for x in said.to_pylist()], pa.string())
    return pc.coalesce(_first((_has(t, "all utilities [are|] included"), "all")), listed, _first((_has(t, "utilities [are|] included"), "unspecified")))


def _items(said: str) -> Iterator[str]:
    """The items of a list, the longest that fits first."""
    words = [w for w in said.split() if w not in (",", "and")]
    while words:
        n = 2 if " ".join(words[:2]) in UTILITIES else 1
        yield " ".join(words[:n])
        words = words[n:]


def _total(group: str) -> str:
    return rf"\b{any_of(TOTAL)}(?: (?:is|of|:))* \$ {group}\b"


@fact(pa.float64())
def total_monthly(raw: pa.Array, t: pa.Array) -> pa.Array:
    return _number(_read(t, _total(f"(?P<x>{amounts(99_999)})")))


@fact(pa.float64())
def rent(raw: pa.Array, t: pa.Array) -> pa.Array:
    """The first amount of three or four figures, or with thousands apart, that isn't the total's."""
    return _number(_read(_without(t, _total(f"(?:{amounts(99_999)})")), rf"\$ (?P<x>{amounts(9_999)})"))


@fact(pa.bool_(), said=False)
def beds_range(raw: pa.Array, t: pa.Array) -> pa.Array:
    """Bedrooms of several units: no number is this one's."""
    return pc.match_substring_regex(t, several(r"\d(?:\.5)?", ["and", "or", "/", "-", "to"], any_of(BED)))


@fact(pa.bool_(), said=False)
def area_range(raw: pa.Array, t: pa.Array) -> pa.Array:
    return pc.match_substring_regex(t, several(r"\d{2,5}", ["-", "to"], "sqft"))


@fact(pa.float64())
def beds(raw: pa.Array, t: pa.Array) -> pa.Array:
    n = _number(_read(t, rf"\b(?P<x>\d+(?:\.5)?) ?{any_of(BED)}\b"))
    return pc.if_else(beds_range(raw, t), pa.scalar(None, n.type), n)


@fact(pa.float64())
def baths(raw: pa.Array, t: pa.Array) -> pa.Array:
    return _number(_read(t, rf"\b(?P<x>\d+(?:\.5)?) ?{any_of(BATH)}\b"))


@fact(pa.float64())
def area_sqft(raw: pa.Array, t: pa.Array) -> pa.Array:
    n = _number(_read(t, rf"\b(?P<x>{figures(700, 9_999)}) ?sqft\b"))
    return pc.if_else(area_range(raw, t), pa.scalar(None, n.type), n)


@fact(pa.int32())
def floor(raw: pa.Array, t: pa.Array) -> pa.Array:
    """A number beside a floor's label, the first in the text; one that counts bedrooms isn't one."""
    level = any_of(LEVEL)
    t = _without(t, rf"\b{level} ?\d{{1,2}} ?{any_of(BED)}\b")
    found = pc.extract_regex(t, rf"\b{level} ?(?P<a>\d{{1,2}})\b|\b(?P<b>\d{{1,2}})(?:st|nd|rd|th)? {level}\b|\b(?P<c>{'|'.join(ORDINALS)}) {level}\b")
    after, before, word = (pc.struct_field(found, x) for x in "abc")
    figures = pc.if_else(pc.equal(after, ""), before, after)
    n = pc.if_else(pc.equal(figures, ""), pc.add(pc.index_in(word, pa.array(ORDINALS)), 1), pc.if_else(pc.equal(figures, ""), "0", figures).cast(pa.int32()))
    return _within(n, 1, 80)


@fact(pa.string())
def parking(raw: pa.Array, t: pa.Array) -> pa.Array:
    """`no parking is included` says nothing of what may be paid for (none that is dedicated does); other denials come before all else."""
    stall = (STALLS, maybe(SPOTS))
    t = _cut(t, rule(["no"], maybe(OF_STALLS, 2), *stall, maybe(LINKS), INCLUDED))
    none = [rule(["no", "without"], maybe(OF_STALLS + DEDICATED, 2), STALLS), rule(*stall, maybe(LINKS), ["not available", "unavailable"])]
    affirmed = _cut(t, rule(DENIALS, maybe(OF_STALLS + DEDICATED, 2), STALLS))
    given = [rule(["free"], ["parking"]), rule(*stall, maybe(["and locker"]), maybe(LINKS), INCLUDED), rule(GIVES, maybe(ARTICLES + COUNTS), maybe(OF_STALLS, 2), STALLS)]
    offered = [rule(COUNTS, maybe(OF_STALLS, 2), PORTS), rule(COUNTS, maybe(OF_STALLS, 2), ["parking"], SPOTS), rule(*stall, maybe(LINKS), OFFERED)]
    available = pc.or_(pc.match_substring_regex(t, rf"✔ {rule(['parking'])}\b"), _follows(t, *offered))
    return _first((_follows(t, *none), "Unavailable"), (_follows(affirmed, *given), "Included"), (available, "Available"))


@fact(pa.bool_())
def in_suite_laundry(raw: pa.Array, t: pa.Array) -> pa.Array:
    """True, or null: a denial isn't a fact about the building."""
    machines = [w for w in WASHERS if "dryer" in w]
    inside = (machines + INITIALS, WITHIN, maybe(ARTICLES), HOMES)
    own = [rule(OWN, LAUNDRY + machines), rule(*inside), rule(HOMES, HAS + GIVES, maybe(ARTICLES), machines)]
    lacks = denied(OWN, LAUNDRY + machines, states=["shared"]) + denied(*inside)
    return _first((pc.and_not(_follows(t, *own), _follows(t, *lacks)), True))


@fact(pa.bool_())
def building_laundry(raw: pa.Array, t: pa.Array) -> pa.Array:
    there = [rule(SHARED, LAUNDRY), rule(COINS), rule(LAUNDRY, ["in"], maybe(ARTICLES), BUILDINGS)]
    lacks = denied(SHARED, LAUNDRY) + [rule(DENIALS, SHARED, WASHERS)]
    return _first((pc.and_not(_follows(t, *there), _follows(t, *lacks)), True))


@fact(pa.bool_())
def full_unit(raw: pa.Array, t: pa.Array) -> pa.Array:
    return _first((_has(t, *ROOM_ONLY), False), (_has(t, *WHOLE_UNIT), True))


@fact(pa.int32())
def walk_score(raw: pa.Array, t: pa.Array) -> pa.Array:
    return _within(_read(t, r"\bwalk ?score[ :]*(?P<x>\d{2,3})").cast(pa.int32()), 0, 100)


@fact(pa.string())
def density(raw: pa.Array, t: pa.Array) -> pa.Array:
    return _first((_has(t, *WALKABLE), "walkable"), (_has(t, *SPARSE), "sparse"))


@fact(pa.string())
def pets(raw: pa.Array, t: pa.Array) -> pa.Array:
    return _first((_has(t, *PETS_NO), "no_pets"), (_has(t, *PETS_YES), "friendly"), (_has(t, *PETS_MAYBE), "conditional"))


@fact(pa.bool_())
def den(raw: pa.Array, t: pa.Array) -> pa.Array:
    return _first((_has(t, *DEN), True))


@fact(pa.bool_(), said=False)
def gym(raw: pa.Array, t: pa.Array) -> pa.Array:
    return _has(t, *GYM)


@fact(pa.bool_(), said=False)
def gym_near(raw: pa.Array, t: pa.Array) -> pa.Array:
    return _has(t, *GYM_NEAR)


@fact(pa.bool_(), said=False)
def grocery_near(raw: pa.Array, t: pa.Array) -> pa.Array:
    return _has(t, *GROCERY_NEAR)


# -- over DataFrames ----------------------------------------------------------------------------------------------------

#: The texts of a listing that facts are read from, in this order, those that it has.
PARTS = ("title", "description", "source_attributes", "address", "notes")


def listing_text(columns: list[str]) -> Column:
    """All texts of a listing as one; null parts are left out."""
    return F.concat_ws(" ", *(F.col(c) for c in PARTS if c in columns))


def with_facts(rows: DataFrame, text: Column, *names: str, into: str = "facts") -> DataFrame:
    """rows and a struct of the named facts (all, marks too, if none is named) of a text, read once a row: only the text goes through
    Python, so other columns are pruned, and filters on them reach the scan."""
    chosen = {n: f for n, f in {**EXTRACTORS, **MARKS}.items() if not names or n in names}
    kind = "struct<" + ",".join(f"{n}:{KINDS[n][1]}" for n in chosen) + ">"
    fields = [pa.field(n, KINDS[n][0]) for n in chosen]

    def run(raw: pa.Array) -> pa.Array:
        t = plain(raw)
        found = [f(raw, t) for f in chosen.values()]
        found = [x.cast(k.type) if isinstance(x, pa.Array) else pa.nulls(len(raw), k.type) for x, k in zip(found, fields, strict=True)]
        return pa.StructArray.from_arrays(found, fields=fields)

    return rows.withColumn(into, F.arrow_udf(run, kind)(text))


def parking_reconciled(structured: Column, from_text: Column) -> Column:
    """state, claims: where the source's field and the text disagree, the field is contradictory and both claims stay."""
    clash = structured.isNotNull() & from_text.isNotNull() & (F.lower(structured) != F.lower(from_text))
    return F.struct(
        F.when(clash, F.lit("contradictory")).when(structured.isNull() & from_text.isNull(), F.lit("not_stated")).otherwise(F.lit("observed")).alias("state"),
        F.when(~clash, F.coalesce(structured, from_text)).alias("value"),
        F.when(clash, F.array(structured, from_text)).alias("claims"),
    )
