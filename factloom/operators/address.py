"""Street addresses in texts: the part of an address that names the street, identities of addresses, and whether a text
speaks of one address only. Addresses are read word by word; what is done with them is built-in functions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalar as S
from .display import holds_run

#: Street types by their spellings, and directions.
TYPES = {
    "street": "Street", "st": "Street", "avenue": "Avenue", "ave": "Avenue", "road": "Road", "rd": "Road", "boulevard": "Boulevard", "blvd": "Boulevard", "drive": "Drive", "dr": "Drive", "lane": "Lane", "ln": "Lane",
    "crescent": "Crescent", "cres": "Crescent", "court": "Court", "ct": "Court", "place": "Place", "pl": "Place", "square": "Square", "sq": "Square", "terrace": "Terrace", "ter": "Terrace", "highway": "Highway", "hwy": "Highway",
    "parkway": "Parkway", "pkwy": "Parkway", "trail": "Trail", "trl": "Trail", "way": "Way",
}
DIRECTIONS = {"n": "North", "north": "North", "s": "South", "south": "South", "e": "East", "east": "East", "w": "West", "west": "West"}
_POSTAL = r"^(\d{5}(-\d{4})?|[a-z]\d[a-z]|\d[a-z]\d|[a-z]\d[a-z]\d[a-z]\d)$"
#: Digits of a number, characters of a name.
MOST_DIGITS, MOST_NAME = 6, 71
_ADDRESS = "array<struct<number:string,prefix:string,name:string,type:string,suffix:string>>"
_FIELDS = ["number", "prefix", "name", "type", "suffix"]


class _Reader:
    """Reads the words of a text one after the other: a number opens an address, the words after it are its name, a street
    type closes it, and a direction right after that belongs to it. Anything but a word ends what is open."""

    def __init__(self) -> None:
        self.found: list[dict] = []
        self.number, self.name, self.just_closed = None, [], False

    def _close(self, name: list[str], street: str, prefix: str | None = None) -> None:
        self.found.append({"number": self.number, "prefix": prefix, "name": " ".join(name).lower(), "type": street, "suffix": None})
        self.number, self.name = None, []

    def stop(self) -> None:
        """No more words belong to what is open. A direction was the name itself, if only a street type came after it."""
        if self.number and len(self.name) > 1 and _plain(self.name[0]) in DIRECTIONS and (street := TYPES.get(_plain(self.name[1]))):
            self._close(self.name[:1], street)
        self.number, self.name, self.just_closed = None, [], False

    def word(self, w: str) -> None:
        low = _plain(w)
        if self.number is None:
            if self.just_closed and low in DIRECTIONS:
                self.found[-1]["suffix"] = DIRECTIONS[low]
            self.just_closed = False
            if w.isdecimal() and len(w) <= MOST_DIGITS:
                self.number = w
            return
        named = self.name[1:] if len(self.name) > 1 and _plain(self.name[0]) in DIRECTIONS else self.name
        alone = len(self.name) == 1 and _plain(self.name[0]) in DIRECTIONS
        if low in TYPES and named and not alone:
            self._close(named, TYPES[low], DIRECTIONS[_plain(self.name[0])] if named is not self.name else None)
            self.just_closed = True
        elif not named and not w[0].isalnum():
            self.stop()
        elif len(" ".join(named)) + 1 + len(w) > MOST_NAME:
            self.stop()
            self.word(w)
        else:
            self.name.append(w)


def _plain(w: str) -> str:
    return w.lower().removesuffix(".")


def read_addresses(text: str) -> list[dict]:
    """number, prefix, name, type and suffix of the street addresses in a text, in order."""
    reader, word = _Reader(), []
    for c in text + "\0":
        if c.isalnum() or c in ".'-":
            word.append(c)
            continue
        if word:
            reader.word("".join(word))
            word = []
        if not c.isspace():
            reader.stop()
    return reader.found


def addresses(text: Column) -> Column:
    """An array of struct(number, prefix, name, type, suffix) of the street addresses in a text, in order, types and directions in full."""

    def run(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([(f, pa.string()) for f in _FIELDS]))
        return pa.array([read_addresses(t or "") for t in texts.to_pylist()], kind)

    return F.arrow_udf(run, _ADDRESS)(text)


def identity(a: Column) -> Column:
    """Of an address what tells it from others: number, name, type and direction, wherever this stands."""
    return F.concat_ws("|", a.number, a["name"], F.lower(a.type), F.coalesce(F.lower(F.coalesce(a.suffix, a.prefix)), F.lit("")))


def canonical(a: Column) -> Column:
    """An address as it is written in full; ordinals keep their small letters."""
    name = F.array_join(F.transform(F.split(a["name"], " "), lambda w: F.when(w.rlike(r"^\d"), w).otherwise(F.initcap(w))), " ")
    return F.concat_ws(" ", a.number, a.prefix, name, a.type, a.suffix)


def subject(text: Column) -> Column:
    """The first precise address of a text, in full; null without one. A range of numbers (12-16) is none."""
    return F.get(F.transform(addresses(text), canonical), F.lit(0))


def about(subject_text: Column, city: Column, *fields: Column) -> Column:
    """Whether texts speak of the subject's address and of no other, and one of them names it together with the city."""
    own = F.get(F.transform(addresses(subject_text), identity), F.lit(0))
    said = [F.transform(addresses(f), identity) for f in fields]
    only = F.size(F.array_except(F.concat(*said), F.array(own))) == 0
    together = F.lit(False)
    for f, ids in zip(fields, said, strict=True):
        together = together | (F.array_contains(ids, own) & holds_run(f, city))
    return F.coalesce(own.isNotNull() & only & together, F.lit(False))


def street_token(address: Column, places: list[str], prefixes: list[str]) -> Column:
    """What of an address names the street: without street types, postal codes and the words of places. Such a word stays at the
    very beginning, where something follows it. A direction before a place's word (north vancouver) goes with it if the address
    has another direction, else it is the street's own. What goes at the beginning stays, if it is no place's word."""
    t = F.filter(S.directions(S.tokens(address, S.KEY_MARKS), S.KEY_DIRECTIONALS), lambda w: ~w.isin(*S.STREET_ENDINGS))
    ways = [*S.KEY_DIRECTIONALS, *S.KEY_DIRECTIONALS.values()]
    several = F.size(F.filter(t, lambda w: w.isin(*ways))) >= 2
    place = lambda w: F.coalesce(w.isin(*places), F.lit(False)) if places else F.lit(False)

    def keeps(w: Column, i: Column) -> Column:
        before_place = (w.isin(*prefixes) if prefixes else F.lit(False)) & place(F.get(t, i + 1))
        return ~place(w) & F.when(before_place, ~several).otherwise(~w.rlike(_POSTAL))

    kept = F.transform(t, lambda w, i: F.when(keeps(w, i), i))
    least = F.array_min(kept)
    stays = lambda w, i: keeps(w, i) | F.when(place(F.get(t, F.lit(0))), i == 0).otherwise(i < least)
    return F.coalesce(F.when(least.isNotNull(), F.array_join(F.filter(t, stays), " ")), F.lit(""))
