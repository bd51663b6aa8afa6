"""A public byte-pair vocabulary, read on the driver and handed to the tasks.

The file has a fixed size (some 50,000 lines, under a megabyte), so it travels as one broadcast
and executors need no copy of it on their disks. Its path is a parameter.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import numpy as np
from pyspark.sql import SparkSession

DEFAULT_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_BYTES = 8 << 20
#: Fixed value: how the vocabulary's makers cut a text into pieces.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

STRETCH, RUN = 1 << 18, 1 << 10
#: What the vocabulary's pattern takes for white space.
_BLANK = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
_BLANKS = re.compile(f"{_BLANK}+")
_LONG_RUN = re.compile(f"{_BLANK}{{{RUN},}}")


def encode(encoding, text: str) -> list[int]:
    """Tokens of a text of any length, equal to those of the text encoded at once.

    The pattern cuts before the last white space of a run that something follows, so texts are
    cut there: into stretches of about ``STRETCH`` characters, and around runs of ``RUN`` or more white
    spaces. Such a run is one piece of the pattern, and is given to the merges as one, since the pattern's search
    would step back over the whole run. A stretch without white space stays whole.
    """
    if len(text) <= RUN:
        return encoding.encode_ordinary(text)
    out, at = [], 0

    def stretches(high: int) -> None:
        nonlocal at
        while high - at > STRETCH:
            gap = next((g for g in _BLANKS.finditer(text, at + STRETCH // 2, high) if at < g.end() - 1 and g.end() < high), None)
            if gap is None:
                break
            out.extend(encoding.encode_ordinary(text[at:gap.end() - 1]))
            at = gap.end() - 1
        out.extend(encoding.encode_ordinary(text[at:high]))
        at = high

    for run in _LONG_RUN.finditer(text):
        stretches(run.start())
        at = run.end() - (run.end() < len(text))
        out.extend(encoding._encode_single_piece(text[run.start():at]))
    stretches(len(text))
    return out


def share(spark: SparkSession, path: str = DEFAULT_PATH):
    """Broadcast the bytes of a ``.tiktoken`` file."""
    with open(path, "rb") as file:
        data = file.read(MAX_BYTES + 1)
    if len(data) > MAX_BYTES:
        raise ValueError(f"{path} is larger than {MAX_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


@functools.lru_cache(maxsize=2)
def _load(key: str, data: bytes):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}
    encoding = tiktoken.Encoding(key, pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    lengths[list(ranks.values())] = [len(t) for t in ranks]
    return encoding, lengths


def encoder(shared):
    """(encoding, bytes of every token) of a broadcast vocabulary, built once per Python worker."""
    data = shared.value
    return _load(hashlib.md5(data).hexdigest(), data)
