"""Document fingerprints by consistent weighted sampling."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import tune

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Samples of the signature of a text without terms.
EMPTY = 0


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WeightedSampler:
    """Signatures of weighted term sets.

    For sample k and a term of weight S, with r and c from Gamma(2, 1) and b from U(0, 1), all drawn from hashes of
    (term, k): t = floor(ln S / r + b), ln a = ln c - r (t - b + 1).  The term with the least a gives the sample: a
    16-bit hash of (term, t).  Two signatures agree in a sample with the probability sum(min) / sum(max) of the
    weights, the generalised Jaccard similarity (and 2**-16 by chance).

    The draws of the terms met most are remembered; ``memory`` bounds their number.
    """

    def __init__(self, samples: int = 128, seed: int = 42, memory: int = 50_000):
        self.samples, self.memory = samples, memory
        self.salts = _mix(np.arange(1, samples + 1, dtype=np.uint64) * _GOLDEN + np.uint64(seed))
        self.rows: dict[bytes, int] = {}
        #: For each remembered term: ln a at weight 1, and r, b and ln c.
        self.once, self.r, self.b, self.log_c = (np.empty((memory, samples), dtype=np.float32) for _ in range(4))
        self.hashes = np.empty(memory, dtype=np.uint64)
        self.uses = np.zeros(memory, dtype=np.int64)

    def draws(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """r, b and ln c for each term and sample."""
        h = _mix(hashes[:, None] ^ self.salts[None, :])
        g = _mix(h + _GOLDEN)
        m, scale = np.uint64((1 << 21) - 1), np.float32(2**-21)
        unit = lambda x, shift: ((x >> np.uint64(shift)) & m).astype(np.float32) * scale + scale * np.float32(0.5)
        r = -np.log(unit(h, 0) * unit(h, 21))
        c = -np.log(unit(g, 0) * unit(g, 21))
        return r, unit(h, 42), np.log(c)

    def _forget(self) -> None:
        """Keeps the half of the terms that was met most; their numbers of uses are halved."""
        n, half = len(self.rows), self.memory // 2
        keep = np.sort(np.argpartition(-self.uses[:n], half - 1)[:half]) if n > half else np.arange(n)
        for table in (self.once, self.r, self.b, self.log_c, self.hashes):
            table[: len(keep)] = table[keep]
        self.uses[: len(keep)] = self.uses[keep] >> 1
        self.uses[len(keep) :] = 0
        terms = list(self.rows)
        self.rows = {terms[k]: i for i, k in enumerate(keep.tolist())}

    def _places(self, terms: list[bytes]) -> np.ndarray | None:
        """The rows of the terms; none where they are too many to remember."""
        if len(terms) > self.memory // 2:
            return None
        missing = [x for x in terms if x not in self.rows]
        if len(missing) + len(self.rows) > self.memory:
            self._forget()
            missing = [x for x in terms if x not in self.rows]
        if missing:
            hashes = np.fromiter((xxhash.xxh64_intdigest(x) for x in missing), np.uint64, len(missing))
            n = len(self.rows)
            for i in range(0, len(missing), 4096):
                part = slice(n + i, n + min(i + 4096, len(missing)))
                r, b, log_c = self.draws(hashes[i : i + 4096])
                self.r[part], self.b[part], self.log_c[part] = r, b, log_c
                self.once[part] = log_c - r * (np.float32(1) - b)
            self.hashes[n : n + len(missing)] = hashes
            self.rows.update(zip(missing, range(n, n + len(missing)), strict=True))
        at = np.fromiter(map(self.rows.__getitem__, terms), np.int64, len(terms))
        self.uses[at] += 1
        return at

    def _least(self, once: np.ndarray, hashes: np.ndarray, weights: np.ndarray, heavy: np.ndarray, of_heavy: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each sample the least ln a, and hash and t of its term."""
        t = np.zeros(self.samples, dtype=np.int64)
        every = np.arange(self.samples)
        if len(heavy):
            r, b, log_c = of_heavy
            ts = np.floor(np.log(weights[heavy].astype(np.float32))[:, None] / r + b)
            once[heavy] = log_c - r * (ts - b + np.float32(1))
        least = np.argmin(once, axis=0)
        if len(heavy):
            where = np.full(len(weights), -1)
            where[heavy] = np.arange(len(heavy))
            row = where[least]
            t = np.where(row >= 0, ts[row, every], 0).astype(np.int64)
        return once[least, every], hashes[least], t

    def __call__(self, weights: dict[bytes, int]) -> np.ndarray:
        """The signature of a weighted set: ``samples`` unsigned 16-bit numbers; all EMPTY without terms."""
        if not weights:
            return np.full(self.samples, EMPTY, dtype=np.uint16)
        terms = list(weights)
        counts = np.fromiter(weights.values(), np.int64, len(terms))
        at = self._places(terms)
        if at is not None:
            heavy = np.flatnonzero(counts > 1)
            own = at[heavy]
            _, hashes, t = self._least(self.once[at], self.hashes[at], counts, heavy, (self.r[own], self.b[own], self.log_c[own]))
        else:  # a text of more terms than can be remembered, by parts
            best = np.full(self.samples, np.inf, dtype=np.float32)
            hashes, t = np.zeros(self.samples, dtype=np.uint64), np.zeros(self.samples, dtype=np.int64)
            for i in range(0, len(terms), 4096):
                part = np.fromiter((xxhash.xxh64_intdigest(x) for x in terms[i : i + 4096]), np.uint64, len(terms[i : i + 4096]))
                r, b, log_c = self.draws(part)
                heavy = np.flatnonzero(counts[i : i + 4096] > 1)
                a, h, x = self._least(log_c - r * (np.float32(1) - b), part, counts[i : i + 4096], heavy, (r[heavy], b[heavy], log_c[heavy]))
                better = a < best
                best, hashes, t = np.where(better, a, best), np.where(better, h, hashes), np.where(better, x, t)
        mixed = _mix(hashes + t.astype(np.uint64) * _GOLDEN + self.salts)
        return (mixed & np.uint64(0xFFFF)).astype(np.uint16)


def terms_of(text: str) -> Counter:
    """Words of a text (lower-case A-Z, split at ASCII white space) with their counts."""
    return Counter(text.encode("utf-8").lower().split())


def encode(signature: np.ndarray) -> str:
    """A signature as text: four hex digits for each sample."""
    return signature.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, a_empty: bool, b_empty: bool) -> float:
    """Share of equal samples; two sets without terms are alike, one without and one with are not."""
    if a_empty or b_empty:
        return 1.0 if a_empty and b_empty else 0.0
    return float(np.count_nonzero(a == b)) / len(a)


def fingerprints(docs: DataFrame, samples: int = 128, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, fingerprint`` for each row, without a shuffle; a null text counts as the empty one."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = WeightedSampler(samples, seed)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([encode(sampler(terms_of(x))) for x in texts], pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def _range_of(key: Column, starts: list[int], at: int) -> Column:
    """The number of the last start that isn't above the key, found by halving, and whether the key equals it."""
    if len(starts) == 1:
        return F.struct(F.lit(at).alias("range"), (key == F.lit(starts[0])).alias("first"))
    half = len(starts) // 2
    return F.when(key < F.lit(starts[half]), _range_of(key, starts[:half], at)).otherwise(_range_of(key, starts[half:], at + half))


def edited_fingerprints(docs: DataFrame, samples: int = 128, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of texts and of their edited texts, and their likeness to the edited and to the next text.

    The edited text is the text with its last floor(n_chars / 4) code points replaced by the first as many (or all)
    of the next document in ascending id; after the last comes the first.  Rows with equal ids go by text; a null id
    comes first and a null text is the empty one.  Of an empty table nothing is returned; a table of one row is its
    own next.

    Documents are dealt to ranges of ids once, so that next documents are neighbours.  The first document of each
    range also goes to the range before it.  Only the bounds of the ranges are gathered on the driver.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    least, bounds = rows.agg(F.min("key"), F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 10_000)).first()
    starts = [least if least is not None else 0, *sorted({b for b in bounds or [] if b != least})]
    n = len(starts)
    # Its own range; and, for the first id of a range, as a guest in the range before it.
    dealt = rows.withColumn("place", _range_of(F.col("key"), starts, 0))
    own = F.struct(F.col("place.range").alias("range"), F.lit(False).alias("guest"))
    before = F.struct(F.pmod(F.col("place.range") - 1, F.lit(n)).alias("range"), F.lit(True).alias("guest"))
    homes = F.when(F.col("place.first"), F.array(own, before)).otherwise(F.array(own))
    dealt = dealt.withColumn("home", F.explode(homes)).select("home.range", "home.guest", "key", "doc_id", "text")
    dealt = dealt.repartition(n, "range").sortWithinPartitions("range", "guest", "key", "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [x.split()[0] for x in schema.split(", ")]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Each own document with the text after it."""
        last, done = None, True
        for batch in batches:
            for span, guest, doc, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                if last is not None and not done:
                    yield last[1], last[2], text
                # of the guests (the rows of one id) only the first is a next document
                done = guest
                last = (span, doc, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = WeightedSampler(samples, seed)
        out: list[tuple] = []
        held: tuple[str, np.ndarray, bool] | None = None
        for doc, text, after in pairs(batches):
            if held is None or held[0] != text:
                terms = terms_of(text)
                held = (text, sampler(terms), not terms)
            _, own, own_empty = held
            q = len(text) // 4
            edited = text[: len(text) - q] + after[:q]
            terms = terms_of(edited)
            other = sampler(terms)
            terms_next = terms_of(after)
            held = (after, sampler(terms_next), not terms_next)
            out.append((doc, len(text), hashlib.sha256(edited.encode("utf-8")).hexdigest(), encode(own), encode(other), likeness(own, other, own_empty, not terms), likeness(own, held[1], own_empty, held[2])))
            if len(out) >= 256:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return dealt.mapInArrow(run, schema)
