"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re

import numpy as np
import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(spark, folder, table, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/{table}.parquet").select(*columns).collect()]


def least_reachable(ids, linked):
    """For each position the smallest id that links reach; linked: boolean matrix."""
    best = list(ids)
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            for j in np.nonzero(linked[i])[0]:
                if best[j] < best[i]:
                    best[i], changed = best[j], True
    return best


def simhash(text, shingle=3):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    k = min(shingle, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), seed=42) for i in range(len(words) - k + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def align_score(passage, item, match=2, mismatch=-1, gap=-1):
    table = [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    best = 0
    for i, a in enumerate(item, 1):
        for j, b in enumerate(passage, 1):
            table[i][j] = max(
                0, table[i - 1][j - 1] + (match if a == b else mismatch), table[i - 1][j] + gap, table[i][j - 1] + gap
            )
            best = max(best, table[i][j])
    return best
