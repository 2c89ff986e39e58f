"""Product codes of vectors, learnt by Yinyang Lloyd rounds over integers.

Vectors are cut into PARTS parts; each part position has a codebook of ENTRIES entries. A round assigns every part to the
nearest entry of its codebook and moves the entries to the means of their parts. Most assignments don't change, and most
entries are far away, so a round looks at few distances (Ding et al., 2015):

* the entries of a codebook are clustered into groups, once;
* a part keeps an upper bound of the distance to its own entry, and for each group one lower bound of the distance to the
  group's other entries;
* when entries move, bounds give way by as much as the entry, or the farthest-moving entry of a group, has moved;
* only groups whose lower bound isn't above the upper one any more are scanned.

Bounds are floats that are rounded outwards, so they only decide what is skipped. What is scanned is compared by squared
distances of integers, ties to the lower index, and an entry that is skipped is farther by a strict inequality: the codes
are those of plain rounds over all entries.

Vectors lie in blocks, a row each, with their codes and bounds, in a table that each round reads and writes anew; no vector
is ever shuffled. A task sums up its own parts, a row at its end; these rows are all that is combined, so the driver gets
the codebooks' numbers and nothing that grows with the vectors.

Edge cases: vectors that are null or empty, or hold null or components that aren't finite, are dropped; so are vectors of
another length than the one of the least vec_id; a length that PARTS doesn't divide is filled up with zeros; integers are
bounded by what keeps an error within a long (about 1.9e8 for 64 components, an x of 46,000); fewer different vec_ids than
ENTRIES make a smaller codebook; of rows of one vec_id the least vector is the entry; rows without vec_id come last there,
as one; repeated rows count, and are returned, each; an empty table gives an empty result; further columns are dropped.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Of a codebook's entries, and steps that cluster them.
GROUPS, GROUPING = 4, 5
_FAR = np.iinfo(np.int64).max
_BLOCK = "dim int, ids array<long>, labels array<string>, ints binary"
_SEED = "seeds array<struct<id:long,ints:array<int>>>"
_STATE = f"{_BLOCK}, codes binary, upper binary, lower binary, sums array<long>, scanned long"
_KINDS = {"dim": pa.int32(), "ids": pa.list_(pa.int64()), "labels": pa.list_(pa.string()), "ints": pa.binary(), "codes": pa.binary(), "upper": pa.binary(), "lower": pa.binary(), "sums": pa.list_(pa.int64()), "scanned": pa.int64()}
_KINDS["seeds"] = pa.list_(pa.struct([("id", pa.int64()), ("ints", pa.list_(pa.int32()))]))


def _row(schema: str, **values: object) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([values.get(c)], _KINDS[c]) for c in names], names)


def bound(dim: int) -> int:
    """Two vectors within +-bound differ by a squared distance below 2^63."""
    return math.isqrt(((1 << 63) - 1) // (4 * dim))


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of vectors of one length, filled up with zeros to a multiple of PARTS."""
    n, dim = x.shape
    most = bound(dim)
    with np.errstate(over="ignore"):
        v = np.clip(np.floor(SCALE * x.astype(np.float64)), -most, most).astype(np.int32)
    return np.pad(v, ((0, 0), (0, -dim % PARTS)))


def blocks(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """A row for the vectors of one length in an Arrow batch, and their least ids with a vector each."""
    schema = f"{_BLOCK}, {_SEED}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = column.flatten()
            bad = ~np.isfinite(flat.fill_null(np.nan).to_numpy(zero_copy_only=False))
            ends = np.cumsum(n)
            good = (n > 0) & (np.diff(np.concatenate([[0], np.cumsum(bad)])[np.concatenate([[0], ends])]) == 0)
            values = flat.fill_null(0).to_numpy(zero_copy_only=False)
            for dim in np.unique(n[good]).tolist():
                at = np.flatnonzero(good & (n == dim))
                ints = integers(values[(ends[at] - dim)[:, None] + np.arange(dim)])
                ids, labels = batch.column("id").take(pa.array(at)).to_pylist(), batch.column("label").take(pa.array(at)).to_pylist()
                least: dict = {}
                for i in sorted(range(len(at)), key=lambda i: (ids[i] is None, ids[i] or 0)):
                    if ids[i] not in least and len(least) == ENTRIES:
                        break
                    least[ids[i]] = min(least.get(ids[i], ints[i].tolist()), ints[i].tolist())
                yield _row(schema, dim=dim, ids=ids, labels=labels, ints=ints.tobytes(), seeds=[{"id": k, "ints": v} for k, v in least.items()])

    picked = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].alias("vector"), vectors[label_col].cast("string").alias("label"))
    return picked.mapInArrow(run, schema)


def seeds(blocked: DataFrame) -> tuple[int, np.ndarray]:
    """The length of vectors that count, and the first codebooks: the parts of the least vec_ids (PARTS x entries x components)."""
    s = blocked.select("dim", F.explode("seeds").alias("s")).select("dim", "s.*")
    first = s.orderBy(F.col("id").asc_nulls_last(), "ints").first()
    if first is None:
        return 0, np.zeros((PARTS, 0, 1), np.int64)
    least = s.filter(F.col("dim") == first.dim).groupBy("id").agg(F.min("ints").alias("ints")).orderBy(F.col("id").asc_nulls_last()).limit(ENTRIES)
    found = np.array([r.ints for r in least.collect()], np.int64)
    return first.dim, found.reshape(len(found), PARTS, -1).transpose(1, 0, 2).copy()


def grouped(book: np.ndarray) -> np.ndarray:
    """The group of each entry (PARTS x entries): a few Lloyd steps over the entries themselves, from entries far apart."""
    out = np.zeros(book.shape[:2], np.int64)
    for p, entries in enumerate(book.astype(np.float64) if out.size else []):
        chosen = [0]
        for _ in range(min(GROUPS, len(entries)) - 1):
            chosen.append(int(((entries[:, None] - entries[chosen][None]) ** 2).sum(2).min(1).argmax()))
        centres = entries[chosen]
        for _ in range(GROUPING):
            out[p] = ((entries[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            centres = np.array([entries[out[p] == g].mean(0) if (out[p] == g).any() else centres[g] for g in range(len(centres))])
    return out


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances (rows x entries)."""
    return ((x[:, None, :] - entries[None]) ** 2).sum(2)


def up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(x.astype(np.float32), np.float32(-np.inf)), np.float32(0))


@dataclass
class Codebooks:
    """Entries (PARTS x entries x components), their groups, and how far each has moved in the last round."""

    entries: np.ndarray
    groups: np.ndarray
    moved: np.ndarray

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Codes, upper and lower bounds of x (rows x PARTS x components), by a scan of all entries."""
        n = len(x)
        codes, upper, lower = np.zeros((n, PARTS), np.uint8), np.zeros((n, PARTS), np.float32), np.full((n, PARTS, GROUPS), np.inf, np.float32)
        rows = np.arange(n)
        for p in range(PARTS):
            d = squares(x[:, p], self.entries[p])
            codes[:, p] = d.argmin(1)
            upper[:, p] = up(np.sqrt(d[rows, codes[:, p]]))
            d[rows, codes[:, p]] = _FAR
            self._bound(p, d, lower[:, p], np.ones((n, GROUPS), bool))
        return codes, upper, lower, n * PARTS * self.entries.shape[1]

    def _bound(self, p: int, d: np.ndarray, lower: np.ndarray, scanned: np.ndarray) -> None:
        for g in range(GROUPS):
            inside = self.groups[p] == g
            if inside.any():
                least = d[:, inside].min(1)
                lower[scanned[:, g], g] = np.where(least == _FAR, np.float32(np.inf), down(np.sqrt(least)))[scanned[:, g]]

    def reassign(self, x: np.ndarray, codes: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Change codes and bounds to what holds after the entries have moved; how many distances were computed."""
        looked = 0
        for p in range(PARTS):
            c, u, low = codes[:, p], upper[:, p], lower[:, p]
            moved, group = self.moved[p], self.groups[p]
            u[:] = up(u.astype(np.float64) + moved[c])
            drift = np.array([moved[group == g].max(initial=0) for g in range(GROUPS)])
            low[:] = np.where(np.isinf(low), low, down(low.astype(np.float64) - drift))
            at = np.flatnonzero(u >= low.min(1))
            own = ((x[at, p] - self.entries[p][c[at]]) ** 2).sum(1)
            u[at] = up(np.sqrt(own))
            looked += len(at)
            open_ = u[at] >= low[at].min(1)
            at, own = at[open_], own[open_]
            if not len(at):
                continue
            fails = low[at] <= u[at, None]
            d = np.full((len(at), len(group)), _FAR)
            for g in range(GROUPS):
                members, some = np.flatnonzero(group == g), np.flatnonzero(fails[:, g])
                if len(members) and len(some):
                    d[some[:, None], members] = squares(x[at[some], p], self.entries[p][members])
                    looked += len(some) * len(members)
            rows, old = np.arange(len(at)), c[at]
            d[rows, old] = own
            new = d.argmin(1)
            u[at] = up(np.sqrt(d[rows, new]))
            bounds = low[at]
            left = np.flatnonzero((new != old) & ~fails[rows, group[old]])  # its own entry becomes one of a group's others
            bounds[left, group[old[left]]] = np.minimum(bounds[left, group[old[left]]], down(np.sqrt(own[left])))
            d[rows, new] = _FAR
            self._bound(p, d, bounds, fails)
            low[at], c[at] = bounds, new
        return looked

    def sums(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Of each entry, the sums of its parts' components and their number (PARTS x entries x components + 1)."""
        out = np.zeros((*self.entries.shape[:2], self.entries.shape[2] + 1), np.int64)
        for p in range(PARTS):
            np.add.at(out[p], codes[:, p], np.concatenate([x[:, p], np.ones((len(x), 1), np.int64)], 1))
        return out

    def after(self, sums: np.ndarray) -> Codebooks:
        """Means, rounded down, of Python's integers (sums may be longer than 64 bits); unused entries stay."""
        count, entries = sums[:, :, -1:], self.entries.copy()
        used = count[:, :, 0] > 0
        entries[used] = (sums[used][:, :-1] // count[used]).astype(np.int64)
        moved = np.sqrt(((entries - self.entries).astype(np.float64) ** 2).sum(2)) * (1 + 1e-9)
        return Codebooks(entries, self.groups, moved)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def _parts(row: dict, book: Codebooks) -> np.ndarray:
    return np.frombuffer(row["ints"], np.int32).reshape(-1, PARTS, book.entries.shape[2]).astype(np.int64)


def _coded(row: dict, x: np.ndarray, book: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    if row.get("codes") is None:
        return book.assign(x)
    codes = np.frombuffer(row["codes"], np.uint8).reshape(len(x), PARTS).copy()
    upper = np.frombuffer(row["upper"], np.float32).reshape(len(x), PARTS).copy()
    lower = np.frombuffer(row["lower"], np.float32).reshape(len(x), PARTS, GROUPS).copy()
    return codes, upper, lower, book.reassign(x, codes, upper, lower)


def assigned(state: DataFrame, book: Codebooks) -> DataFrame:
    """The blocks with codes and bounds under these entries; at the end of each task a row of its sums, without vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, looked = None, 0
        for batch in batches:
            for row in batch.to_pylist():
                x = _parts(row, book)
                codes, upper, lower, n = _coded(row, x, book)
                looked += n
                total = book.sums(x, codes) + (0 if total is None else total)
                kept = {k: row[k] for k in ("dim", "ids", "labels", "ints")}
                yield _row(_STATE, **kept, codes=codes.tobytes(), upper=upper.tobytes(), lower=lower.tobytes())
        if total is not None:
            yield _row(_STATE, sums=total.reshape(-1).tolist(), scanned=looked)

    return state.mapInArrow(run, _STATE)


def coded(state: DataFrame, book: Codebooks) -> DataFrame:
    """vec_id, label, code and error under these entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = _parts(row, book)
                codes = _coded(row, x, book)[0]
                error = sum(((x[:, p] - book.entries[p][codes[:, p]]) ** 2).sum(1) for p in range(PARTS))
                text = codes.tobytes().hex()
                text = [text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)]
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(row["labels"], pa.string()), pa.array(text), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return state.mapInArrow(run, "vec_id long, label string, code string, error long")


def rounds(blocked: DataFrame) -> tuple[DataFrame, Codebooks, list[int]]:
    """The blocks after ROUNDS rounds, the codebooks to assign them to at last, and the distances that each round computed."""
    spark, state, looked = blocked.sparkSession, None, []
    dim, entries = seeds(blocked)
    book = Codebooks(entries, grouped(entries), np.zeros(entries.shape[:2]))
    for _ in range(ROUNDS):
        before = state
        source = blocked.filter(F.col("dim") == dim).drop("seeds") if before is None else before.filter("ids is not null")
        state = common.materialize(assigned(source, book))
        if before is not None:
            common.release(spark, [before.materialized])
        sums = state.filter("sums is not null").select("scanned", F.posexplode("sums").alias("place", "x"))
        got = sums.groupBy("place").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("scanned").alias("scanned")).collect()
        total = np.zeros(entries.size + PARTS * entries.shape[1], object)
        for r in got:  # a number for each component of the codebooks
            total[r.place] = int(r.x)
        looked.append(got[0].scanned if got else 0)
        book = book.after(total.reshape(*entries.shape[:2], entries.shape[2] + 1))
    return state.filter("ids is not null"), book, looked


def compress(vectors: DataFrame) -> tuple[DataFrame, Codebooks, list[int]]:
    """vec_id, label, code and error of each vector that counts, the final codebooks, and the distances of each round."""
    with common.Scratch(vectors.sparkSession) as scratch:
        state, book, looked = rounds(common.materialize(blocks(vectors)))
        return scratch.keep(common.materialize(coded(state, book))), book, looked


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, book, _ = compress(common.table(spark, sf_dir, "embeddings"))
    total = common.materialize(rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"))
    joined = rows.join(total, F.col("label").eqNullSafe(F.col("of")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(book.digest()).alias("codebooks_sha256"))


def _sql() -> str:
    """Plain Lloyd rounds over all entries."""
    square = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"
    out = [
        f"k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        f"x AS MATERIALIZED (SELECT vec_id, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS x FROM k, (SELECT unnest(range({PARTS})) AS p))",
        f"b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM x QUALIFY e < {ENTRIES})",
    ]
    for r in range(ROUNDS + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT vec_id, p, any_value(x) AS x, min({{'d': {square}, 'e': e}}) AS best FROM x JOIN b{r} USING (p) GROUP BY vec_id, p)")
        if r < ROUNDS:
            out.append(f"u{r} AS (SELECT p, best.e AS e, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS y FROM a{r})")
            out.append(f"m{r} AS (SELECT p, e, i, sum(y)::BIGINT AS s, count(*) AS n FROM u{r} GROUP BY ALL)")
            out.append(f"l{r} AS (SELECT p, e, list((s - (s % n + n) % n) // n ORDER BY i) AS c FROM m{r} GROUP BY p, e)")
            out.append(f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(l.c, b.c) AS c FROM b{r} b LEFT JOIN l{r} l ON l.p = b.p AND l.e = b.e)")
    out.append(f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})")
    out.append(f"t AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id)")
    return f"WITH {', '.join(out)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM t JOIN k USING (vec_id), h"


OP12_SQL = _sql()
