"""Repetition inside a single document: compression bands over runs of words, and the exact share of what they let through."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
#: (words from, limit): a text whose ratio of run codes reaches the limit of its length is not repetitive. See `repetition`.
LIMITS = ((0, float("inf")), (64, 1.0), (256, 0.99))
#: (bytes of the word stream from, limit): a text whose ratio of bytes reaches it is incompressible. Short texts have none.
INCOMPRESSIBLE = ((0, float("inf")), (512, 0.75), (1024, 0.70), (4096, 0.62))
_CHUNK, _WIDEST = 1 << 14, 27


def repeated_words(words: list, run: int = 5) -> int:
    """Words lying in `run` consecutive words which already stood, beginning at an earlier word."""
    n, seen, count, covered = len(words), set(), 0, 0
    code = {}
    ids = [code.setdefault(w, len(code)) for w in words]
    if len(code) == n:
        return 0
    for i, gram in enumerate(zip(*(ids[k:] for k in range(run)))):
        if gram in seen:
            count += i + run - max(covered, i)
            covered = i + run
        else:
            seen.add(gram)
    return count


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_codes(ids: np.ndarray, run: int = 5) -> np.ndarray:
    """One random-looking 64-bit code for every `run` consecutive word numbers; equal runs have equal codes."""
    n = max(len(ids) - run + 1, 0)
    word, code = _mix(ids.astype(np.uint64) + np.uint64(1)), np.zeros(n, dtype=np.uint64)
    for k in range(run):
        code = _mix(code * np.uint64(3) + word[k : k + n])
    return code


class Ratios:
    """Compressed size over size. Run codes go through binary trees that look at every position of a window over the
    whole text, so no repeated code is passed by; bytes of text through an ordinary level."""

    def __init__(self) -> None:
        plain = dict(write_content_size=False, write_checksum=False, write_dict_id=False)
        self.text = zstandard.ZstdCompressor(level=3, **plain)
        self.made: dict[int, zstandard.ZstdCompressor] = {}
        self.plain = plain

    def of_text(self, data: bytes) -> float:
        return len(self.text.compress(data)) / len(data)

    def of_codes(self, codes: np.ndarray) -> float:
        """0 where the text is wider than the widest window: nothing can be said, so it goes to the exact share."""
        wide = max((8 * len(codes)).bit_length(), 12)
        if wide > _WIDEST:
            return 0.0
        if wide not in self.made:
            trees = zstandard.ZstdCompressionParameters(
                strategy=zstandard.STRATEGY_BTLAZY2, min_match=6, window_log=wide, chain_log=wide, hash_log=min(wide, 22), search_log=7, target_length=64, **self.plain
            )
            self.made[wide] = zstandard.ZstdCompressor(compression_params=trees)
        return len(self.made[wide].compress(codes.tobytes())) / (8 * len(codes))


def _limit(table: tuple, n: int) -> float:
    return [limit for start, limit in table if start <= n][-1]


def repetition(df: DataFrame, key: str, text: str, run: int = 5, chunk: int = _CHUNK, every: bool = False) -> DataFrame:
    """(id, words, repeated, share, ratio, chunk_ratio, text_ratio, band): one row per row of `df`.

    Words are runs of letters and digits, in lower case. Every five (`run`) consecutive words have a 64-bit code; `ratio`
    is the zstandard size of a text's codes over their size, `chunk_ratio` the lowest of its fixed chunks of `chunk`
    codes, `text_ratio` that of its words as text, one blank between. band is `repetitive` where ratio or chunk_ratio
    lies below the limit of its length (LIMITS), else `incompressible` where text_ratio reaches its own limit, else
    `ordinary`. The exact repeated and share = repeated / words are computed for `repetitive` texts, and for all with
    `every`; the others have null there: less than a third of their words is repeated.

    Why the band loses none: of n words a third is repeated only if n/15 codes at least stood before (a code covers five
    words). A new code costs its 8 bytes, one that stood before at most 5 (offset and lengths), so the codes shrink by
    n/15 * 3 bytes in 8n, to 0.975, wherever the repeats lie; a code stream without repeats is stored as it is, ratio
    above 1. zstandard stores what shrinks by less than 1/64. Below 64 words the frame outweighs this, hence no limit.

    Null and wordless texts have 0 words, share 0, null ratios and are `ordinary`; texts below 64 words, and those of
    more than 16 million words, wider than a window, are `repetitive` in band. Whole texts of any length; each row by
    itself, no shuffle; other columns are not read.
    """

    def score(docs: list[list[str]], ratios: Ratios) -> list[tuple]:
        number: dict[str, int] = {}
        ids = [number.setdefault(w, len(number)) for words in docs for w in words]
        all_codes, out, start = run_codes(np.array(ids, dtype=np.int64), run), [], 0
        for words in docs:
            n = len(words)
            if not n:
                out.append((0, 0, 0.0, None, None, None, "ordinary"))
                continue
            codes = all_codes[start : start + max(n - run + 1, 0)]
            data = " ".join(words).encode("utf-8", "replace")
            text_ratio = ratios.of_text(data)
            ratio = part = ratios.of_codes(codes) if len(codes) else 1.0
            if len(codes) > chunk:
                part = min(ratios.of_codes(codes[i : i + chunk]) for i in range(0, len(codes) - chunk + 1, chunk))
            repetitive = ratio < _limit(LIMITS, n) or (len(codes) > chunk and part < _limit(LIMITS, chunk))
            band = "repetitive" if repetitive else "incompressible" if text_ratio >= _limit(INCOMPRESSIBLE, len(data)) else "ordinary"
            again = repeated_words(ids[start : start + n], run) if repetitive or every else None
            out.append((n, again, None if again is None else again / n, ratio, part, text_ratio, band))
            start += n
        return out

    def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = Ratios()
        for batch in batches:
            out, held, words = [], [], 0
            for t in batch.column(1).to_pylist():
                held.append(WORD.findall((t or "").lower()))
                words += len(held[-1])
                if words > 500_000:
                    out += score(held, ratios)
                    held, words = [], 0
            out += score(held, ratios)
            cols = list(zip(*out)) or [()] * 7
            types = (pa.int64(), pa.int64(), *[pa.float64()] * 4, pa.string())
            names = ["id", "words", "repeated", "share", "ratio", "chunk_ratio", "text_ratio", "band"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names)

    kind = dict(df.dtypes)[key]
    doubles = ", ".join(f"{c} double" for c in ("share", "ratio", "chunk_ratio", "text_ratio"))
    return df.select(key, F.col(text)).mapInArrow(run_batches, f"id {kind}, words long, repeated long, {doubles}, band string")
