"""URL filters: glob rules run as one bit-parallel automaton over canonical URLs.

Every rule becomes a run of bits in a row of 64-bit words: one bit for each state of a linear automaton. A byte moves
all states of all rules at once: ``D = (D << 1 & step[byte]) | (D & stay[byte])``, where ``step`` holds what a state
accepts and ``stay`` holds the loops of wildcards. numpy does this for a whole batch of URLs.

Globs over ``.host/path``: ``*`` any run of bytes but ``/``, ``**`` any run, ``?`` one byte but ``/``; a glob has to
match all of it. The leading dot lets ``*.example.org/**`` fit the host and its subdomains.

Edge cases: a null URL and one without ``://`` have empty host and path, match no rule and get the default verdict;
repeated rows are judged each; an empty table gives an empty result; further columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

_SLASH = ord("/")
#: Bytes of URLs whose states are held at once.
_ROWS = 8192


@dataclass(frozen=True)
class Rule:
    """name: as reported, or None for a glob that gives a verdict alone. weight: the largest that matches wins."""

    action: str
    glob: str
    name: str | None = None
    tier: int = 0

    @property
    def weight(self) -> tuple[int, int, bool]:
        return self.tier, len(self.name or self.glob.replace("*", "")), self.action == "block"


def host_rule(action: str, host: str, path: str) -> Rule:
    """Fits host and its subdomains where the URL's path starts with path; no wildcards in either."""
    return Rule(action, f"*.{host}{path}**", f"{host}{path}", 1)


#: The rules in force, by host and path.
RULES = [
    host_rule("allow", "org", "/"),
    host_rule("block", "example.org", "/es/"),
    host_rule("block", "example.org", "/en/1"),
    host_rule("allow", "com", "/fr/"),
    host_rule("block", "com", "/de/"),
    Rule("block", "**/cgi-bin/**"),
    Rule("block", "**/wp-login.php"),
    Rule("block", "*/login/**"),
    Rule("block", "*.adserver.*/**"),
    Rule("block", "**.exe"),
    Rule("block", "**.zip"),
]


#: Texts of which so few are left are walked one by one.
FEW = 16


class Automaton:
    """All globs as one multiword Shift-And automaton."""

    def __init__(self, globs: list[str]):
        states: list[tuple[str | None, int]] = []  # what moves into the state, and how it loops: 0 not, 1 but for a slash, 2 always
        self.first, self.last = [], []
        for glob in globs:
            self.first.append(len(states))
            states.append((None, 0))
            raw, i = glob.encode(), 0
            while i < len(raw):
                if raw[i] == ord("*"):
                    double = raw[i : i + 2] == b"**"
                    states[-1] = states[-1][0], max(states[-1][1], 1 + double)
                    i += 1 + double
                else:
                    states.append((raw[i : i + 1], 0))
                    i += 1
            self.last.append(len(states) - 1)
        self.whole: list[list[int]] | None = None
        self.width = max(1, -(-len(states) // 64))
        self.step = np.zeros((256, self.width), np.uint64)
        self.stay = np.zeros((256, self.width), np.uint64)
        self.start = np.zeros(self.width, np.uint64)
        for i, (byte, loop) in enumerate(states):
            word, bit = i // 64, np.uint64(1 << i % 64)
            if byte is None:
                self.start[word] |= bit
            elif byte == b"?":
                self.step[:, word] |= bit
                self.step[_SLASH, word] &= ~bit
            else:
                self.step[byte[0], word] |= bit
            if loop:
                self.stay[:, word] |= bit
                if loop == 1:
                    self.stay[_SLASH, word] &= ~bit

    def _alone(self, state: np.ndarray, text: bytes) -> np.ndarray:
        """The state after text, from this one on."""
        if self.whole is None:
            self.whole = [[int.from_bytes(row.astype("<u8").tobytes(), "little") for row in masks] for masks in (self.step, self.stay)]
        step, stay = self.whole
        now = int.from_bytes(state.astype("<u8").tobytes(), "little")
        for b in text:
            now = now << 1 & step[b] | now & stay[b]
        return np.frombuffer(now.to_bytes(8 * self.width, "little"), "<u8")

    def match(self, texts: list[bytes]) -> np.ndarray:
        """Which text matches which glob: booleans, a row for each text."""
        out = np.zeros((len(texts), len(self.last)), bool)
        size = np.array([len(x) for x in texts], np.int64)
        order = np.argsort(-size, kind="stable")
        raw = np.frombuffer(b"".join(texts) or b"\0", np.uint8)
        at = np.concatenate([[0], np.cumsum(size)])[:-1][order]
        size = size[order]
        state = np.repeat(self.start[None], len(texts), 0)
        top, one = np.uint64(63), np.uint64(1)
        live = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
        for t, n in enumerate(live.tolist()):  # the texts that have a byte t are the first n
            if n < FEW:  # the words of a state as one integer: what numpy costs a step, a few texts don't earn
                for k in range(n):
                    state[k] = self._alone(state[k], raw[at[k] + t : at[k] + size[k]].tobytes())
                break
            now = state[:n]
            byte = raw[at[:n] + t]
            moved = now << one
            if self.width > 1:
                moved[:, 1:] |= now[:, :-1] >> top
            state[:n] = (moved & self.step[byte]) | (now & self.stay[byte])
        for k, i in enumerate(self.last):
            out[order, k] = (state[:, i // 64] >> np.uint64(i % 64)) & one == one
        return out


def judge(urls: DataFrame, rules: list[Rule] = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, the name of the rule that decides (null without one), verdict."""
    url = F.coalesce(urls[url_col], F.lit(""))
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    plain = urls.select(
        urls[id_col],
        F.translate(F.regexp_extract(url, parts, 1), common.UPPER, common.LOWER).alias("host"),
        F.regexp_extract(url, parts, 2).alias("path"),
    )
    ranked = sorted(rules, key=lambda r: r.weight, reverse=True)
    schema = f"{id_col} {urls.schema[id_col].dataType.simpleString()}, host string, path string, rule string, verdict string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton([r.glob for r in ranked])
        names = np.array([r.name for r in ranked] + [None], object)
        actions = np.array([r.action for r in ranked] + [default], object)
        for whole in batches:
            for lo in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(lo, _ROWS)
                host, path = batch.column("host").to_pylist(), batch.column("path").to_pylist()
                found = machine.match([f".{h}{p}".encode() if h or p else b"" for h, p in zip(host, path, strict=True)])
                best = np.where(found.any(1), found.argmax(1), len(ranked)) if ranked else np.zeros(batch.num_rows, int)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(names[best], pa.string()), pa.array(actions[best], pa.string())], [id_col, "host", "path", "rule", "verdict"]
                )

    return plain.mapInArrow(run, schema)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"))


#: The same by regular expressions.
OP2_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r AS (
  SELECT *, CASE
    WHEN regexp_matches('.' || host, '\.example\.org$') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN regexp_matches('.' || host, '\.example\.org$') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN regexp_matches('.' || host, '\.com$') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN regexp_matches('.' || host, '\.com$') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN regexp_matches('.' || host, '\.org$') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches('.' || host || path, '(?s)(/cgi-bin/.*|/wp-login\.php|\.exe|\.zip)$') OR regexp_matches('.' || host || path, '(?s)^[^/]*(/login/.*)$')
    OR regexp_matches('.' || host || path, '(?s)^[^/]*\.adserver\.[^/]*/') THEN 'block'
  ELSE 'allow' END AS verdict
FROM r
"""
