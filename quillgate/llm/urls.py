"""URL filter: a sorted array of 64-bit digests, memory-mapped by every task and probed by binary search.

A rule is a host and a path; it fits its host and all subdomains of it where the url's path starts with
the rule's path.  The keys of all (host suffix, path beginning) combinations that a rule could have are
looked up at once; a key that is found counts only if the stored string is equal, so collisions cannot
block or allow anything.  The longest fitting rule wins (of equally long ones, the longer host).

Defined results: a null url, or one without "://", has an empty host and an empty path; where no rule
fits, the url is not in the list and the verdict is ``allow``; repeated rows get equal results; a rule
listed twice with different verdicts blocks; with no rules everything is allowed.
"""

import hashlib
import os
import re
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import functions as F

#: Most bytes of rule strings in one array; the files are copied to every machine.
MOST_RULE_BYTES = 4 << 30
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_SHIPPED = set()
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(text):
    return xxhash.xxh64_intdigest(text.encode("utf-8"))


def split_url(url):
    """Host (A-Z lower-cased) and path of a url."""
    found = _URL.search(url or "")
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


def write_digests(folder, rules, hashed=digest):
    """Write (host, path, verdict) rules as sorted keys, string offsets, strings and verdicts; returns the file names."""
    best = {}
    for host, path, verdict in rules:
        key = (host.translate(_LOWER), path)
        best[key] = "block" if "block" in (verdict, best.get(key)) else verdict
    entries = sorted((hashed(host + path), host + path, len(host), verdict) for (host, path), verdict in best.items())
    blob = [text.encode("utf-8") for _, text, _, _ in entries]
    if sum(map(len, blob)) > MOST_RULE_BYTES:
        raise ValueError(f"rules have more than {MOST_RULE_BYTES} bytes; split them into several arrays")
    arrays = {
        "keys": np.array([e[0] for e in entries], np.uint64),
        "ends": np.cumsum([0, *map(len, blob)]).astype(np.int64),
        "text": np.frombuffer(b"".join(blob), np.uint8),
        "block": np.array([e[3] == "block" for e in entries], bool),
        "host": np.array([e[2] for e in entries], np.int32),
        "paths": np.array(sorted({len(p) for _, p in best}), np.int32),
        "labels": np.array(sorted({h.count(".") + 1 for h, _ in best}), np.int32),
    }
    mark = hashlib.sha256(b"".join(k.encode() + v.tobytes() for k, v in sorted(arrays.items()))).hexdigest()[:16]
    names = {}
    for kind, array in arrays.items():
        names[kind] = f"digests-{mark}-{kind}.npy"
        np.save(os.path.join(folder, names[kind]), array)
    return names


class Digests:
    """Memory-mapped arrays of ``write_digests`` and their lookup."""

    def __init__(self, paths, hashed=digest):
        self.hashed = hashed
        # an empty file part cannot be mapped
        self.parts = {k: np.load(p, mmap_mode="r" if os.path.getsize(p) > 128 else None) for k, p in paths.items()}

    def text(self, i):
        return self.parts["text"][self.parts["ends"][i]:self.parts["ends"][i + 1]].tobytes().decode("utf-8")

    def probes(self, host, path):
        """(rule string, host length) of every combination that a rule of this list could have."""
        labels = host.split(".")
        for count in self.parts["labels"]:
            if count <= len(labels):
                suffix = ".".join(labels[len(labels) - count:])
                for size in self.parts["paths"]:
                    if size <= len(path):
                        yield suffix + path[:size], len(suffix)

    def judge(self, parts):
        """Rule number of each (host, path), or -1: one binary search for the probes of all of them."""
        owner, strings, hosts = [], [], []
        for i, (host, path) in enumerate(parts):
            for text, size in self.probes(host, path):
                owner.append(i)
                strings.append(text)
                hosts.append(size)
        keys = self.parts["keys"]
        best = np.full(len(parts), -1, np.int64)
        if not len(keys) or not owner:
            return best
        wanted = np.array([self.hashed(s) for s in strings], np.uint64)
        at = np.searchsorted(keys, wanted)
        rank = [(-1, -1)] * len(parts)
        for j in np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == wanted):
            i = int(at[j])
            while i < len(keys) and keys[i] == wanted[j]:  # equal keys stand side by side
                if self.parts["host"][i] == hosts[j] and self.text(i) == strings[j]:
                    if (len(strings[j]), hosts[j]) > rank[owner[j]]:
                        rank[owner[j]], best[owner[j]] = (len(strings[j]), hosts[j]), i
                i += 1
        return best


def url_verdict(spark, rules, url_column):
    """struct<host string, path string, rule string, verdict string> of every url.

    ``rules`` are (host, path, verdict) rows on the driver, bounded in size; their arrays are shipped as files.
    """
    folder = tempfile.mkdtemp(prefix="digests-")
    names = write_digests(folder, rules)
    for name in names.values():
        if (spark.sparkContext.applicationId, name) not in _SHIPPED:  # equal rules have equal files
            spark.sparkContext.addFile(os.path.join(folder, name))
            _SHIPPED.add((spark.sparkContext.applicationId, name))

    @F.arrow_udf("host string, path string, rule string, verdict string")
    def of(url: pa.Array) -> pa.Array:
        digests = Digests({k: SparkFiles.get(n) for k, n in names.items()})
        parts = [split_url(u) for u in url.to_pylist()]
        found = digests.judge(parts)
        return pa.StructArray.from_arrays([
            pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()),
            pa.array([digests.text(i) if i >= 0 else None for i in found], pa.string()),
            pa.array(["block" if i >= 0 and digests.parts["block"][i] else "allow" for i in found], pa.string())],
            names=["host", "path", "rule", "verdict"])

    return of(url_column)
