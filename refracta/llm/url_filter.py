"""Allow and block rules for URLs, looked up in a memory-mapped sorted array of digests.

A rule is a host and the start of a path. Its key is the text ``host/path``; the index holds
the 64-bit xxhash of every key in order, next to the keys themselves. A URL can only match the
keys made of a tail of its host and a start of its path that is as long as some rule's path, so
these are probed by binary search, a batch at a time, and equal digests are confirmed against
the stored keys. The file travels to the executors with ``addFile``, and all workers of a
machine share its mapped pages.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refracta.session import cut_lineage, scratch_path

#: Bytes of rule keys that one index takes; more rules go over ``judged_by_join``.
MOST_BYTES = 1 << 30
PIECE = 1 << 20  # bytes of an index that are written at a time
DEFAULT = "allow"  # the verdict where no rule fits


def digest(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key)


class Index:
    """The arrays of an index: digests in order, key offsets, key bytes, path lengths, verdicts."""

    PARTS = ("digests", "offsets", "keys", "hosts", "blocks", "lengths")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, rules: Sequence[tuple[str, str, str]]) -> Index:
        """From (verdict, host, path); of a repeated host and path the first rule holds."""
        unique: dict[tuple[str, str], str] = {}
        for verdict, host, path in rules:
            unique.setdefault((host, path), verdict)
        rows = [((host + path).encode(), len(host.encode()), len(path), v == "block") for (host, path), v in unique.items()]
        rows = sorted((digest(key), key, host, path, block) for key, host, path, block in rows)
        return cls(
            {
                "digests": np.array([r[0] for r in rows], np.uint64),
                "offsets": np.cumsum([0, *(len(r[1]) for r in rows)], dtype=np.int64),
                "keys": np.frombuffer(b"".join(r[1] for r in rows) or b"\0", np.uint8),
                "hosts": np.array([r[2] for r in rows], np.int32),
                "blocks": np.array([r[4] for r in rows], bool),
                "lengths": np.unique(np.array([r[3] for r in rows], np.int32)),
            }
        )

    def packed(self) -> Iterator[bytes]:
        """8-byte aligned arrays behind a table of contents, in pieces of at most PIECE bytes."""
        arrays = [np.ascontiguousarray(getattr(self, p)) for p in self.PARTS]
        yield np.array([[a.nbytes, ord(a.dtype.char)] for a in arrays], np.int64).tobytes()
        for a in arrays:
            raw = a.view(np.uint8)
            for at in range(0, len(raw), PIECE):
                yield raw[at : at + PIECE].tobytes()
            yield b"\0" * (-a.nbytes % 8)

    def save(self, path: str) -> None:
        """The packed arrays as one file."""
        with open(path, "wb") as out:
            out.writelines(self.packed())

    @classmethod
    def mapped(cls, path: str) -> Index:
        """The arrays as views of the mapped file; nothing is read before it is probed."""
        raw = np.memmap(path, np.uint8, "r")
        head = raw[: 16 * len(cls.PARTS)].view(np.int64).reshape(-1, 2)
        at, arrays = head.nbytes, {}
        for name, (size, kind) in zip(cls.PARTS, head.tolist()):
            arrays[name] = raw[at : at + size].view(np.dtype(chr(kind)))
            at += size + -size % 8
        return cls(arrays)

    def found(self, keys: list[bytes], hosts: np.ndarray) -> np.ndarray:
        """The rule of each key whose host part has the given length, or -1."""
        wanted = np.fromiter(map(digest, keys), np.uint64, len(keys))
        out = np.full(len(keys), -1, np.int64)
        if not len(self.digests):
            return out
        at = np.searchsorted(self.digests, wanted)
        equal = self.digests[np.minimum(at, len(self.digests) - 1)] == wanted
        for i in np.flatnonzero(equal):
            k = at[i]
            while k < len(self.digests) and self.digests[k] == wanted[i]:
                stored = self.keys[self.offsets[k] : self.offsets[k + 1]].tobytes()
                if stored == keys[i] and self.hosts[k] == hosts[i]:
                    out[i] = k
                    break
                k += 1
        return out

    def key(self, rule: int) -> str:
        return self.keys[self.offsets[rule] : self.offsets[rule + 1]].tobytes().decode()


def host_of(url: str = "url") -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower())


def path_of(url: str = "url") -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: str) -> Column:
    at = F.locate("://", F.col(url))
    return F.when(at > 0, F.col(url).substr(at + 3, F.length(url))).otherwise(F.lit(""))


def tails(host: str) -> list[str]:
    """A host and the domains above it: ``a.b.c``, ``b.c``, ``c``."""
    parts = host.split(".")
    return [".".join(parts[i:]) for i in range(len(parts))]


def _probe(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index.mapped(SparkFiles.get(name))
        lengths = index.lengths.tolist()
        for batch in batches:
            keys, owners, sizes = [], [], []
            rows = zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            for row, (host, path) in enumerate(rows):
                for tail in tails(host):
                    for n in lengths:
                        if n <= len(path):
                            keys.append((tail + path[:n]).encode("utf-8", "surrogatepass"))
                            owners.append(row)
                            sizes.append(len(tail.encode("utf-8", "surrogatepass")))
            rule = np.full(batch.num_rows, -1, np.int64)
            longest = np.zeros(batch.num_rows, np.int64)
            found = index.found(keys, np.array(sizes, np.int32))
            for i in np.flatnonzero(found >= 0):
                if len(keys[i]) > longest[owners[i]]:
                    longest[owners[i]], rule[owners[i]] = len(keys[i]), found[i]
            yield pa.record_batch(
                [
                    *batch.columns,
                    pa.array([index.key(r) if r >= 0 else None for r in rule], pa.string()),
                    pa.array([(DEFAULT if r < 0 else "block" if index.blocks[r] else "allow") for r in rule], pa.string()),
                ],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    return run


def _shipped(spark: SparkSession, index: Index) -> str:
    """Write the index to the shared folder, from where every executor gets it; its name there."""
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(f"{scratch_path(spark, 'url-rules')}.bin")
    files = target.getFileSystem(sc._jsc.hadoopConfiguration())
    out = files.create(target)
    for piece in index.packed():
        out.write(bytearray(piece))
    out.close()
    sc.addFile(files.makeQualified(target).toString())
    return target.getName()


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per row of ``pages`` (page_id, url).

    ``rules`` are (verdict, host, path). A rule fits its host and all domains below it when
    the path starts with the rule's; of several the longest ``host/path`` holds, and ``rule``
    is that text. Without one, ``rule`` is NULL and the verdict ``allow``. A NULL url, or one
    without ``://``, has an empty host and path, which no rule fits. Repeated rows are judged
    each. Other columns are ignored, whatever their names. Empty tables are fine.
    """
    if sum(len(h) + len(p) for _, h, p in rules) > MOST_BYTES:
        raise ValueError("too many rules for one index: use judged_by_join")
    parts = pages.select("page_id", host_of().alias("host"), path_of().alias("path"))
    kind = dict(pages.dtypes)["page_id"]
    name = _shipped(pages.sparkSession, Index.build(rules))
    return parts.mapInArrow(_probe(name), f"page_id {kind}, host string, path string, rule string, verdict string")


def judged_by_join(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """The same for a table of rules (verdict, host, path) of any size, by a join on the key.

    Each page is looked up once per tail of its host and start of its path.
    """
    parts = cut_lineage(
        pages.select("page_id", host_of().alias("host"), path_of().alias("path")).withColumn(
            "row", F.monotonically_increasing_id()
        )
    )
    labels = F.split("host", r"\.")
    ends = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    starts = F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    probes = parts.select("row", F.explode(ends).alias("host"), starts.alias("starts")).select(
        "row", "host", F.explode("starts").alias("path")
    )
    first = rules.groupBy("host", "path").agg(F.first("verdict").alias("verdict"))
    fits = probes.join(first, ["host", "path"]).groupBy("row").agg(
        F.max(F.struct(F.octet_length(F.concat("host", "path")), F.concat("host", "path").alias("rule"), "verdict")).alias("best")
    )
    return parts.join(fits, "row", "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(DEFAULT)).alias("verdict")
    )
