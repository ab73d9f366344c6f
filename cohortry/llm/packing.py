"""Packing documents into sequences of a fixed number of tokens by large-item matching.

Documents become token ids and one closing id; only what is longer than a sequence
is cut. Pieces longer than a third of a sequence are the large ones: no three
of them fit together, so they are matched in pairs. Each one above
half takes the largest partner up to half that still fits, from the longest on; partners that are left pair up
among themselves. Smaller pieces then go, from the longest on, where the least room is left behind.

The plan needs only how many pieces there are of each length: at most one number per length. Pieces are
numbered within their length by running numbers of the task that wrote them and totals
of the tasks before, so no task ever holds all pieces of a length. The plan says for
runs of these numbers which sequences they fill.
"""

from __future__ import annotations

import bisect
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.session import stored

_BLANK = re.compile(r"[ \t\n\r]+")
# No token of the tokenizer spans a change between ASCII letters and other ASCII characters, but for an apostrophe before letters.
_CHANGE = re.compile(r"(?<=[A-Za-z])(?=[!-@\[-`{-~])|(?<=[!-&(-@\[-`{-~])(?=[A-Za-z])")
# Words of Latin letters, ASCII digits, and characters that are neither letters nor numbers nor marks are parted into their runs.
_LETTER = "A-Za-zÀ-ÖØ-öø-įı-ſ"
_OTHER = r"!-/:-@\[-`{-~¡-©«-±´¶-¸»¿×÷‐-‧‰-⁞"
_LETTERS = re.compile(f"[{_LETTER}]+")
_GAP, _L, _O, _DIGIT, _ODD = range(5)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Kind and lower case of each character up to the last white space; the last entries stand for all characters after it."""
    chars = "".join(map(chr, range(0x3002)))
    kind, lower = np.full(len(chars), _ODD, np.uint8), np.arange(len(chars), dtype=np.uint32)
    # str.isspace takes four controls for blanks that the tokenizer does not
    for of, found in ((_GAP, re.findall(r"[^\S\x1c-\x1f]", chars)), (_L, re.findall(f"[{_LETTER}]", chars)), (_O, re.findall(f"[{_OTHER}]", chars)), (_DIGIT, "0123456789")):
        kind[[ord(c) for c in found]] = of
    at = np.flatnonzero(kind == _L)
    lower[at] = [ord(chars[i].lower()) for i in at]
    return kind, lower


_KIND, _LOWER = _tables()


@dataclass(frozen=True)
class Settings:
    capacity: int = 2048  # tokens of a sequence
    tokenizer: str = field(default_factory=lambda: public_tokenizers.path("word_bpe_49k.json"))  # one that parts white space, letters and others, in lower case
    end: int = 0  # id that closes a document
    known_words: int = 500_000  # ids of so many different words are kept at hand in a task
    segment: int = 1 << 20  # characters of texts that are looked at together


class Words:
    """Token ids of texts, as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and no token spans it, so the ids of a text are those of its
    blank-separated words in a row, and those of a word are the ids of its runs of letters and of other characters. A
    word or run met again is not tokenised again; new ones are tokenised many at a time.
    """

    def __init__(self, settings: Settings):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(settings.tokenizer)
        letters = Tokenizer(made.model)  # for runs of letters in lower case: nothing to normalize
        letters.pre_tokenizer = made.pre_tokenizer
        self.settings = settings
        self.encode, self.encode_letters = made.encode, letters.encode
        added = [re.escape(token.content) for token in made.get_added_tokens_decoder().values()]
        self._special = re.compile("|".join(added) or "(?!)")
        self.known: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        """Puts the ids of words and runs that are not known yet into ``known``."""
        letters, parts = [], {}
        for word in words:
            if _LETTERS.fullmatch(word):
                letters.append(word)
            elif self._special.search(word):
                parts[word] = [word]
            else:
                # lower case only where no letter can combine with a mark
                parts[word] = _CHANGE.split(word.lower() if word.isascii() else word)
        for some in _by(256, letters):
            found = self.encode_letters(" ".join(some), add_special_tokens=False)
            self._keep(some, found.ids, np.cumsum(np.bincount(found.word_ids, minlength=len(some))))
        for some in _by(256, list({run for runs in parts.values() for run in runs}.difference(self.known))):
            found = self.encode(" ".join(some), add_special_tokens=False)
            ends = np.cumsum([len(run) + 1 for run in some])
            self._keep(some, found.ids, np.searchsorted(np.array([begin for begin, _ in found.offsets]), ends))
        for word, runs in parts.items():
            self.known[word] = b"".join(map(self.known.__getitem__, runs))

    def _keep(self, runs: list[str], ids: list[int], ends: np.ndarray) -> None:
        data, begin = np.array(ids, "<u4").tobytes(), 0
        for run, end in zip(runs, (4 * ends).tolist(), strict=True):
            self.known[run] = data[begin:end]
            begin = end

    def segments(self, text: str) -> Iterator[str]:
        """The text in parts that end at a blank; a single longer word is a part of its own."""
        size, at = self.settings.segment, 0
        while len(text) - at > size:
            cut = max(text.rfind(blank, at + 1, at + size) for blank in " \t\n\r")
            if cut < 0:
                found = _BLANK.search(text, at + size)
                cut = found.start() if found else len(text)
            yield text[at:cut]
            at = cut
        yield text[at:] if at else text

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; texts of some length together are looked at together."""
        segments = [(i, segment) for i, text in enumerate(texts) for segment in self.segments(text)]
        out: list[list[bytes]] = [[] for _ in texts]
        first = 0
        while first < len(segments):
            last, size = first + 1, len(segments[first][1])
            while last < len(segments) and size + len(segments[last][1]) <= self.settings.segment:
                last, size = last + 1, size + len(segments[last][1])
            some = segments[first:last]
            for (i, _), found in zip(some, self._ids([segment for _, segment in some]), strict=True):
                out[i].append(found)
            first = last
        return [found[0] if len(found) == 1 else b"".join(found) for found in out]

    def _ids(self, texts: list[str]) -> list[bytes]:
        whole = "\n".join(texts)
        runs, begins = self._runs(whole)
        words = runs.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, words))
        new = [word for word, ids in zip(words, found, strict=True) if ids is None]
        if new:
            if len(self.known) + len(new) > self.settings.known_words:
                self.known.clear()
                new = words
            self._learn(new)
            found = list(map(self.known.__getitem__, words))
        # the ids of all different words in a row, and where those of each run stand there
        ids, size = np.frombuffer(b"".join(found), "<u4"), np.array(list(map(len, found)), np.int64) // 4
        which = runs.indices.to_numpy()
        many = size[which]
        ends = np.cumsum(np.r_[0, many])
        places = np.repeat((np.cumsum(size) - size)[which] - ends[:-1], many) + np.arange(ends[-1])
        data = ids[places].tobytes()
        last = np.cumsum([len(text) + 1 for text in texts])
        cuts = [0, *(4 * ends[np.searchsorted(begins, last)]).tolist()]
        return [data[begin:end] for begin, end in zip(cuts, cuts[1:])]

    def _runs(self, whole: str) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The runs of a text in lower case, words of other characters whole and as they are, and where each begins."""
        chars = np.frombuffer(whole.encode(), np.uint8) if whole.isascii() else np.frombuffer(whole.encode("utf-32-le"), "<u4")
        kind = _KIND.take(chars, mode="clip")
        for found in self._special.finditer(whole):
            kind[found.start()] = _ODD
        at = np.flatnonzero(kind)
        chars, kind = chars[at], kind[at]
        word = np.diff(at, prepend=-2) > 1  # where one begins
        start = np.diff(kind, prepend=_GAP) != 0
        start[1:] &= (chars[:-1] != ord("'")) | (kind[1:] != _L)
        start |= word | (kind == _DIGIT)
        lower = _LOWER.astype(chars.dtype).take(chars, mode="clip")
        odd = kind == _ODD
        if odd.any():
            of = np.cumsum(word) - 1
            odd = np.bincount(of, odd)[of] > 0  # every character of such a word
            start &= word | ~odd
            lower = np.where(odd, chars, lower)
        starts = np.flatnonzero(start)
        if lower.dtype == np.uint8:
            data, offsets = lower, np.r_[starts, len(lower)]
        else:
            data = lower.tobytes().decode("utf-32-le").encode()
            width = 1 + (lower >= 0x80).astype(np.int8) + (lower >= 0x800) + (lower >= 0x10000)
            offsets = np.cumsum(np.r_[0, width])[np.r_[starts, len(lower)]]
        runs = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
        return runs.dictionary_encode(), at[starts]


def _by(many: int, items: list[str]) -> Iterator[list[str]]:
    return (items[first : first + many] for first in range(0, len(items), many))


def id_lists(words: Words, texts: pa.Array) -> Iterator[bytes]:
    """The ids of each text of a column, of few texts at a time."""
    some, size = [], 0
    for text in texts:
        some.append(text.as_py() or "")
        size += len(some[-1])
        if size >= words.settings.segment:
            yield from words.ids(some)
            some, size = [], 0
    yield from words.ids(some)


def pieces(df: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(key, piece, start, length, ids, part, nth) of every piece of every row, as a written table.

    ``ids`` are little-endian unsigned 32-bit numbers; ``start`` counts the ids of the document before the
    piece. ``nth`` numbers the pieces of one length written by one task, ``part``. A null or empty text is the closing id alone.
    Repeated rows and null keys are rows like any other; other columns play no part. An empty table gives an empty result.
    """
    s = settings
    width = 4 * s.capacity
    names = ["key", "piece", "start", "length", "ids", "part", "nth"]
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), *T._parse_datatype_string("piece int, start long, length long, ids binary, part int, nth long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seen = Words(s), TaskContext.get().partitionId(), defaultdict(int)
        end = np.array([s.end], "<u4").tobytes()

        def batch(keys: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
            row, piece, start, length, ids, nth = zip(*rows, strict=True)
            columns = [keys.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary()), pa.array([part] * len(rows), pa.int32()), pa.array(nth, pa.int64())], names=names)

        for given in batches:
            rows, held = [], 0
            for i, found in enumerate(id_lists(words, given.column(1))):
                ids = found + end
                for at in range(0, len(ids), width):
                    cut = ids[at : at + width]
                    length = len(cut) // 4
                    rows.append((i, at // width, at // 4, length, cut, seen[length]))
                    seen[length] += 1
                    held += len(cut)
                    if held > 1 << 22:
                        yield batch(given.column(0), rows)
                        rows, held = [], 0
            if rows:
                yield batch(given.column(0), rows)

    made = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
    return stored(made).withColumnRenamed("key", key)


@dataclass
class Plan:
    """Runs of pieces of one length: ``count`` of them from ``rank`` on, ``per`` to a sequence from ``sequence`` on, at ``offset``."""

    sequences: int = 0
    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # length, rank, sequence, per, offset
    _next: dict[int, int] = field(default_factory=lambda: defaultdict(int))
    _room: dict[int, list[tuple[int, int]]] = field(default_factory=lambda: defaultdict(list))  # room left: (first sequence, how many)

    def _put(self, length: int, sequence: int, many: int, per: int, offset: int) -> None:
        self.runs.append((length, self._next[length], sequence, per, offset))
        self._next[length] += many * per

    def _leave(self, room: int, first: int, many: int) -> None:
        if room > 0 and many > 0:
            self._room[room].append((first, many))

    def _open(self, many: int) -> int:
        first, self.sequences = self.sequences, self.sequences + many
        return first


def plan(counts: dict[int, int], capacity: int) -> Plan:
    """Where ``counts[length]`` pieces of every length go; equal pieces are placed together, as if one after the other."""
    made, left = Plan(), {length: n for length, n in counts.items() if n > 0}
    partners = sorted(length for length in left if capacity < 3 * length and 2 * length <= capacity)
    for length in sorted((x for x in left if 2 * x > capacity), reverse=True):
        n = left[length]
        while n and (at := bisect.bisect_right(partners, capacity - length)):
            other = partners[at - 1]
            many = min(n, left[other])
            first = made._open(many)
            made._put(length, first, many, 1, 0)
            made._put(other, first, many, 1, length)
            made._leave(capacity - length - other, first, many)
            n, left[other] = n - many, left[other] - many
            if not left[other]:
                partners.pop(at - 1)
        if n:
            first = made._open(n)
            made._put(length, first, n, 1, 0)
            made._leave(capacity - length, first, n)
    single = None  # the sequence that waits for a second partner
    for length in reversed(partners):
        n = left[length]
        if single is not None:
            sequence, held = single
            made._put(length, sequence, 1, 1, held)
            made._leave(capacity - held - length, sequence, 1)
            n, single = n - 1, None
        if n // 2:
            first = made._open(n // 2)
            made._put(length, first, n // 2, 2, 0)
            made._leave(capacity - 2 * length, first, n // 2)
        if n % 2:
            sequence = made._open(1)
            made._put(length, sequence, 1, 1, 0)
            single = sequence, length
    if single is not None:
        made._leave(capacity - single[1], single[0], 1)
    for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        n = left[length]
        for room in sorted(x for x in made._room if x >= length):
            if n:
                n = _fill(made, length, n, room, capacity)
        if n:
            per = capacity // length
            made._leave(capacity, made._open(-(-n // per)), -(-n // per))
            _fill(made, length, n, capacity, capacity)
    return made


def _fill(made: Plan, length: int, n: int, room: int, capacity: int) -> int:
    """Puts up to ``n`` pieces where ``room`` is left, filling one sequence after the other; how many are over."""
    per, still = room // length, []
    for first, many in made._room.pop(room):
        full = min(many, n // per)
        if full:
            made._put(length, first, full, per, capacity - room)
            made._leave(room - per * length, first, full)
            n -= full * per
        if n and full < many:
            made._put(length, first + full, 1, n, capacity - room)
            made._leave(room - n * length, first + full, 1)
            n, full = 0, full + 1
        if full < many:
            still.append((first + full, many - full))
    if still:
        made._room[room] = still
    return n


def placed(found: DataFrame, capacity: int = Settings.capacity) -> DataFrame:
    """``found`` (rows with length, part and nth, as ``pieces`` writes them) with sequence_id and offset, without part and nth.

    A sequence's pieces stand one after the other from 0 on, without gaps, and hold at most ``capacity`` tokens. Columns named
    sequence_id or offset give way. An empty table gives an empty result.
    """
    lengths = stored(found.groupBy("length", "part").agg(F.count("*").alias("n")))
    counts = {row["length"]: row["n"] for row in lengths.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    runs = np.array(sorted(plan(counts, capacity).runs), np.int64).reshape(-1, 5)
    marks = runs[:, 0] << 48 | runs[:, 1]
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = stored(lengths.select("length", "part", before.alias("before")))
    kept = [c for c in found.columns if c.lower() not in ("part", "nth", "sequence_id", "offset")]
    ranked = found.join(offsets, ["length", "part"]).select(F.col("length").alias("_l"), (F.col("nth") + F.col("before")).alias("_r"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(kept)])
    schema = T.StructType([*[T.StructField(f"_{i}", found.schema[c].dataType) for i, c in enumerate(kept)], T.StructField("_s", T.LongType()), T.StructField("_o", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                length, rank = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                at = runs[np.searchsorted(marks, length << 48 | rank, side="right") - 1]
                nth = rank - at[:, 1]
                columns = [*batch.columns[2:], pa.array(at[:, 2] + nth // at[:, 3]), pa.array(at[:, 4] + nth % at[:, 3] * length)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return ranked.mapInArrow(run, schema).toDF(*kept, "sequence_id", "offset")


def sequences(placed_pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids) of placed pieces with their ids: the sequences themselves, at most ``capacity`` ids each."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda whole, part: F.concat(whole, part["ids"]))
    return placed_pieces.groupBy("sequence_id").agg(joined.alias("ids"))
