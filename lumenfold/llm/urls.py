"""URL rules by a sorted digest array.

Every rule is a host and a path prefix. The rules' 64-bit xxhash keys are sorted into an array, which lies in a file with
the rules' full strings; executors fetch that file once and memory-map it. A long list makes several such files. A URL is probed under each of its host's
suffixes and each prefix length that some rule has, by vectorised binary search; a probe that meets a key counts only if
the stored string is the same, so colliding keys can't decide.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import shared_dir

#: Bytes of rules in one file, about: more rules make more files, each made by itself and probed one after the other.
INDEX_BYTES = 256 << 20
#: Rows probed at once.
STEP = 4096

_PARTS = re.compile(r"([^/?#]*)([^?#]*)")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ACTIONS = ("block", "allow")

#: The rules of the registered query: (action, host and path prefix).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or where there is no ``://``."""
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    host, path = _PARTS.match(url, at + 3).groups()
    return host.translate(_UPPER), path


def pack(rules) -> bytes:
    """The index as bytes: counts, prefix lengths, sorted keys, string offsets, actions, strings.

    A rule given twice keeps its first action. A rule's path starts at its first slash; one without a slash fits any path.
    """
    seen: dict[bytes, int] = {}
    for action, rule in rules:
        host, slash, path = rule.partition("/")
        seen.setdefault(f"{host.translate(_UPPER)}{slash}{path}".encode(), ACTIONS.index(action))
    keys = np.array([xxhash.xxh64_intdigest(r) for r in seen], np.uint64)
    order = np.argsort(keys, kind="stable")
    strings = [list(seen)[i] for i in order]
    lengths = np.array(sorted({len(r.decode().partition("/")[2]) + ("/" in r.decode()) for r in strings}), np.int64)
    labels = np.array(sorted({r.decode().partition("/")[0].count(".") + 1 for r in strings}), np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in strings])]).astype(np.int64)
    actions = np.array([seen[r] for r in strings], np.int64)
    head = np.array([len(strings), len(lengths), len(labels)], np.int64)
    return b"".join(x.tobytes() for x in (head, lengths, labels, keys[order], offsets, actions)) + b"".join(strings)


class Index:
    """A memory-mapped index."""

    def __init__(self, path: str):
        m = np.memmap(path, np.uint8, "r")
        n, n_len, n_lab = np.frombuffer(m[:24], np.int64).tolist()
        at = 24

        def take(count, kind):
            nonlocal at
            out = m[at : at + 8 * count].view(kind)
            at += 8 * count
            return out

        self.lengths, self.labels = take(n_len, np.int64).tolist(), take(n_lab, np.int64).tolist()
        self.keys, self.offsets, self.actions, self.strings = (
            take(n, np.uint64),
            take(n + 1, np.int64),
            take(n, np.int64),
            m[at:],
        )

    def probes(self, host: str, path: str) -> list[str]:
        """What could be a rule that fits, longest first."""
        names = host.split(".")
        hosts = [".".join(names[-k:]) for k in self.labels if k <= len(names)]
        out = {h + path[:n] for h in hosts for n in self.lengths if n <= len(path)}
        return sorted(out, key=lambda p: (-len(p), p))

    def judge(self, urls: list[tuple[str, str]]) -> list[int]:
        """Number of the longest rule that fits each host and path, or -1."""
        probes = [self.probes(h, p) for h, p in urls]
        flat = [p.encode() for x in probes for p in x]
        keys = np.fromiter((xxhash.xxh64_intdigest(p) for p in flat), np.uint64, len(flat))
        at = np.searchsorted(self.keys, keys)
        found = np.full(len(flat), -1, np.int64)
        for i in np.flatnonzero(at < len(self.keys)):
            j = at[i]
            while j < len(self.keys) and self.keys[j] == keys[i]:
                if bytes(self.strings[self.offsets[j] : self.offsets[j + 1]]) == flat[i]:
                    found[i] = j
                    break
                j += 1
        out, lo = [], 0
        for x in probes:
            out.append(next((int(j) for j in found[lo : lo + len(x)] if j >= 0), -1))
            lo += len(x)
        return out

    def rule(self, j: int) -> str:
        return bytes(self.strings[self.offsets[j] : self.offsets[j + 1]]).decode()


def publish(spark: SparkSession, data: bytes) -> str:
    """Write the index to the shared folder and have every executor fetch it; its name there."""
    name = f"url-rules-{hashlib.sha256(data).hexdigest()[:24]}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        part = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}.part")
        out = fs.create(part, True)
        try:
            for lo in range(0, len(data), 1 << 20):
                out.write(bytearray(data[lo : lo + (1 << 20)]))
        finally:
            out.close()
        fs.rename(part, path)
    spark.sparkContext.addFile(fs.makeQualified(path).toString())
    return name


def segments(rules, limit: int | None = None):
    """The rules in lists of about ``limit`` bytes; one empty list if there are none."""
    held, size = [], 0
    for r in rules:
        held.append(r)
        size += len(r[1].encode()) + 17
        if size >= (limit or INDEX_BYTES):
            yield held
            held, size = [], 0
    if held or not size:
        yield held


def judge_urls(pages: DataFrame, rules=RULES, *, url_col: str = "url", default: str = "allow", keep=("page_id",)) -> DataFrame:
    """For each row: the columns in ``keep``, host, path, rule (the longest that fits, or null) and verdict.

    A rule fits its host and all subdomains where the path starts with the rule's path. Null and malformed URLs have an
    empty host and path and get ``default``; repeated rows are judged one by one; no rules give ``default`` everywhere.
    Only ``keep`` and the URL are read.
    """
    if default not in ACTIONS:
        raise ValueError(f"default is one of {ACTIONS}")
    names = [publish(pages.sparkSession, pack(part)) for part in segments(rules)]
    rows = pages.select(*keep, F.col(url_col).alias("__url"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches):
        indexes = [Index(SparkFiles.get(name)) for name in names]
        for b in batches:
            for lo in range(0, b.num_rows, STEP):
                x = b.slice(lo, STEP)
                split = [parts(u) for u in x.column("__url").to_pylist()]
                best: list[tuple[str | None, str]] = [(None, default)] * len(split)
                for index in indexes:
                    for i, j in enumerate(index.judge(split)):
                        own, rule = best[i][0], index.rule(j) if j >= 0 else None
                        if rule is not None and (own is None or (-len(rule), rule) < (-len(own), own)):
                            best[i] = rule, ACTIONS[index.actions[j]]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(x.column(i) for i in range(x.num_columns - 1)),
                        pa.array([h for h, _ in split], pa.string()),
                        pa.array([p for _, p in split], pa.string()),
                        pa.array([rule for rule, _ in best], pa.string()),
                        pa.array([verdict for _, verdict in best], pa.string()),
                    ],
                    names=[*x.schema.names[:-1], "host", "path", "rule", "verdict"],
                )

    return rows.mapInArrow(run, f"{kinds}, host string, path string, rule string, verdict string")
