"""SentencePiece encoding and decoding by batched Viterbi over numpy arrays.

The given models are of the BPE kind, so the best path is the one whose pieces
greedy merging would make.  That path is found by dynamic programming over
prefixes: the encoding of a prefix ends in one piece only, and a piece may
follow another exactly when merging the two in isolation leaves both as they
are.  Words of equal length advance together, one character a step; the hashes
of all substrings that end there probe the sorted piece keys; of the admissible
pieces (a score of their length, minus one where the pair is not allowed) the
vectorised maximum becomes the backpointer.  Segments that repeat in a batch advance
once.  Encoded words are kept in a bounded store of ids; a text is the gather of its
words' ids.  Results are those of the ``sentencepiece`` library, id by id.

A text is cut at spaces, since no piece holds a space after another character,
and at neighbouring characters that stand together in no piece.  Runs of spaces
have pieces of one lowest score; they merge last and from the left.

The model file is read on the driver only (pieces, scores); the tables made of
it have one row for each piece and are broadcast.

Defined results: a null text counts as empty and has no ids; characters without
a piece become byte pieces; U+2581 is taken as a space, as the format does, and
decodes to one; everything else decodes to itself, byte by byte.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"  # fixed value of the format
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd multiplier of the substring hash
CACHE_WORDS = 400_000
PAIR_SLOTS = 1 << 20
LONG = 200  # characters of a word that advances alone
BATCH_CHARS = 2_000_000
UNIT = re.compile(f"{SPACE}+[^{SPACE}]*")


def _units(text: str) -> list[str]:
    """The words of a text, each with one space in front (not written here); what else there
    is -- more spaces in front, or spaces only -- is a unit that begins with its spaces."""
    if not text:
        return []
    if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
        return [u if len(u) == 1 or u[1] == SPACE else u[1:] for u in UNIT.findall(SPACE + text.replace(" ", SPACE))]
    return text.split(" ")


def _mix(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of code points (the splitmix64 finaliser)."""
    z = codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def merge_greedily(text: str, rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """Best-ranked pair first, leftmost among equals; the pieces and the last merge."""
    parts, last = list(text), None
    while len(parts) > 1:
        best = min((rank.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best[0] == 1 << 60:
            break
        i = best[1]
        last = (parts[i], parts[i + 1])
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return parts, last


class Codec:
    """The tables of one model; built once from its pieces and scores.  The pair
    table and the word cache fill up in each worker and are bounded."""

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("pair_keys", "pair_ok", "cache", "flat", "ends")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._empty()

    @staticmethod
    def of(state: dict) -> Codec:
        """The codec of a broadcast state, one for each worker process."""
        if "codec" not in state:
            codec = Codec.__new__(Codec)
            codec.__setstate__(dict(state))
            state["codec"] = codec
        return state["codec"]

    def _empty(self) -> None:
        self.pair_keys, self.pair_ok = np.full(PAIR_SLOTS, -1, np.int64), np.zeros(PAIR_SLOTS, bool)
        self._forget_words()

    def _forget_words(self) -> None:
        """Unit i has the ids flat[ends[i]:ends[i + 1]]; the cache holds i."""
        self.cache: dict[str, int] = {}
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def __init__(self, pieces: list[tuple[str, float, str]]):
        """pieces: (text, score, kind) by id; kind is normal, byte, unknown or control."""
        self.byte_id = np.zeros(256, np.int32)
        self.raw: list[bytes] = []  # what a piece decodes to
        normal, runs = {}, {}
        for i, (text, score, kind) in enumerate(pieces):
            if kind == "byte":
                self.byte_id[int(text[3:-1], 16)] = i
                self.raw.append(bytes([int(text[3:-1], 16)]))
            elif kind == "normal":
                (runs if text.strip(SPACE) == "" and len(text) > 1 else normal)[text] = (i, score)
                self.raw.append(text.replace(SPACE, " ").encode())
            else:
                self.raw.append(b"" if kind == "control" else " ⁇ ".encode())
        order = sorted((t for t in normal if len(t) > 1), key=lambda t: -normal[t][1])
        rank = {t: k for k, t in enumerate(order)}
        names = [t for t in normal if len(t) == 1] + order
        at = {t: k for k, t in enumerate(names)}
        n = len(names)
        self.at = at
        self.unknown = n  # a character without a piece: in no merge
        self.ids = np.array([normal[t][0] for t in names] + [-1], np.int32)
        self.size = np.array([len(t) for t in names] + [1], np.int64)
        self.rank = np.array([rank.get(t, -1) for t in names] + [-1], np.int64)
        self.left, self.right = np.arange(n + 1), np.arange(n + 1)
        self.made = np.ones(n + 1, bool)  # merging can end in this piece
        pairs = set()
        for k, t in enumerate(names):
            if len(t) > 1:
                parts, last = merge_greedily(t, rank)
                self.made[k] = len(parts) == 1
                if self.made[k]:
                    self.left[k], self.right[k] = at[last[0]], at[last[1]]
                pairs.update(a + b for a, b in zip(t, t[1:]))
        self.longest = int(self.size.max())
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.repeat(BASE, self.longest)]), dtype=np.uint64)
            self.hash = np.zeros(n + 1, np.uint64)
            for k, t in enumerate(names):
                h = np.uint64(0)
                for c in _mix(_codes(t)):
                    h = h * BASE + c
                self.hash[k] = h
            self.hash[n] = np.uint64(1)  # meets no key
            self.order = np.argsort(self.hash[:n])
            self.keys = self.hash[self.order]
            glued = np.array(sorted(pairs))
            both = np.array([_codes(p) for p in glued], np.uint64).reshape(-1, 2)
            self.glue = np.unique(both[:, 0] << np.uint64(32) | both[:, 1])
        self.seen = np.zeros(1 << 18, bool)  # quick refusal before the search
        self.seen[(self.keys >> np.uint64(46)).astype(np.int64)] = True
        self.space_runs = {len(t): v[0] for t, v in runs.items()} | {1: normal[SPACE][0]}
        self.run_rank = {t: 0 for t in runs}
        self._empty()

    # ------------------------------------------------------------ lookups
    def probe(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        may = np.flatnonzero(self.seen[(hashes >> np.uint64(46)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, hashes[may]), len(self.keys) - 1)
        hit = self.keys[at] == hashes[may]
        out[may[hit]] = self.order[at[hit]]
        return out

    def _together(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the two pieces side by side leaves both: undo their
        last merges, the later one first, and look for one across that comes
        before (equal ranks: the left one comes first)."""
        ok, limit = np.ones(len(a), bool), np.full(len(a), 1 << 60, np.int64)
        a, b, live = a.copy(), b.copy(), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            across = self.probe(self.hash[x] * self.power[self.size[y]] + self.hash[y])
            bad = (across >= 0) & (x != self.unknown) & (y != self.unknown)
            bad[bad] = self.rank[across[bad]] < limit[live[bad]]
            ok[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~bad & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[go], x[go], y[go], rx[go], ry[go]
            first = rx > ry
            limit[live] = np.where(first, rx, ry + 1)
            a[live] = np.where(first, self.right[x], x)
            b[live] = np.where(first, y, self.left[y])
        return ok

    def together(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_together`` through a table of pairs decided before (one to a slot)."""
        keys = a * np.int64(len(self.rank)) + b
        slots = (_mix(keys) & np.uint64(PAIR_SLOTS - 1)).astype(np.int64)
        ok = self.pair_ok[slots]
        fresh = np.flatnonzero(self.pair_keys[slots] != keys)
        if len(fresh):
            ok[fresh] = self._together(a[fresh], b[fresh])
            self.pair_keys[slots[fresh]] = keys[fresh]
            # of fresh pairs that share a slot, the one whose key stayed sets the answer
            kept = fresh[self.pair_keys[slots[fresh]] == keys[fresh]]
            self.pair_ok[slots[kept]] = ok[kept]
        return ok

    # ------------------------------------------------------------ Viterbi
    def viterbi(self, codes: np.ndarray) -> np.ndarray:
        """Backpointers of words of one length (rows of code points): the last
        piece of each prefix."""
        words, length = codes.shape
        points = _mix(codes.ravel()).reshape(codes.shape)
        prefix = np.zeros((words, length + 1), np.uint64)
        for j in range(length):
            prefix[:, j + 1] = prefix[:, j] * BASE + points[:, j]
        last = np.full((words, length + 1), -1, np.int64)
        for end in range(1, length + 1):
            best = np.zeros(words, np.int64)  # the longest admissible piece; there is one exactly
            for size in range(1, min(self.longest, end) + 1):
                start = end - size
                piece = self.probe(prefix[:, end] - prefix[:, start] * self.power[size])
                if size == 1:
                    piece[piece < 0] = self.unknown
                rows = np.flatnonzero((piece >= 0) & self.made[piece])
                if start and len(rows):
                    rows = rows[self.together(last[rows, start], piece[rows])]
                better = rows[size > best[rows]]
                best[better], last[better, end] = size, piece[better]
        return last

    def one_path(self, codes: np.ndarray) -> np.ndarray:
        """The same backpointers for one long run of characters, by lookups: a
        step for each of its characters is too short to be worth an array."""
        text, n = codes.tobytes().decode("utf-32-le", "surrogatepass"), len(codes)
        last, known = [-1] * (n + 1), {}
        for end in range(1, n + 1):
            for size in range(min(self.longest, end), 0, -1):
                piece = self.at.get(text[end - size:end], self.unknown if size == 1 else -1)
                if piece < 0 or not self.made[piece]:
                    continue
                before = last[end - size]
                if end > size and (before, piece) not in known:
                    known[before, piece] = bool(self._together(np.array([before]), np.array([piece]))[0])
                if end == size or known[before, piece]:
                    last[end] = piece
                    break
        return np.array(last, np.int64)[None, :]

    def segment_pieces(self, rows: np.ndarray) -> np.ndarray:
        """For segments of one length (rows of code points): the piece that ends at each
        character, or -1."""
        length = rows.shape[1]
        last = self.viterbi(rows) if length <= LONG else np.concatenate([self.one_path(r) for r in rows])
        found = np.full(rows.shape, -1, np.int64)
        rows, at = np.arange(len(rows)), np.full(len(rows), length)
        while len(rows):
            piece = last[rows, at]
            found[rows, at - 1] = piece
            at = at - self.size[piece]
            rows, at = rows[at > 0], at[at > 0]
        return found

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words without spaces but for one in front, one after the other, and where
        each word's end."""
        codes = _codes("".join(words))
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        first = np.zeros(len(codes) + 1, bool)  # where a segment starts: a word, or a pair that no piece holds
        first[0], first[ends] = True, True
        pair = codes[:-1].astype(np.uint64) << np.uint64(32) | codes[1:]
        at = np.minimum(np.searchsorted(self.glue, pair), len(self.glue) - 1)
        first[1:-1] |= self.glue[at] != pair
        starts = np.flatnonzero(first)
        starts, lengths = starts[:-1], np.diff(starts)
        found = np.full(len(codes), -1, np.int64)  # the piece that ends at a character
        order = np.argsort(lengths, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
            length = int(lengths[group[0]])
            places = starts[group][:, None] + np.arange(length)
            rows = codes[places]
            _, one, copy = np.unique(rows.view(np.dtype((np.void, 4 * length))).ravel(), return_index=True, return_inverse=True)
            step = max(1, BATCH_CHARS // (4 * length))
            pieces = [self.segment_pieces(rows[one[lo:lo + step]]) for lo in range(0, len(one), step)]
            found[places] = np.concatenate(pieces)[copy]
        where = np.flatnonzero(found >= 0)
        ids = self.ids[found[where]]
        counts = np.ones(len(where), np.int64)
        lost = np.flatnonzero(found[where] == self.unknown)
        if len(lost):
            spelled = {int(c): self.byte_id[list(chr(c).encode("utf-8", "replace"))] for c in np.unique(codes[where[lost]])}
            counts[lost] = [len(spelled[int(c)]) for c in codes[where[lost]]]
            put = np.cumsum(counts) - counts
            ids = np.repeat(ids, counts)
            for c, bytes_ in spelled.items():
                at = put[lost[codes[where[lost]] == c]]
                for i, x in enumerate(bytes_):
                    ids[at + i] = x
        total = np.concatenate([[0], np.cumsum(counts)])
        return ids, total[np.searchsorted(where, ends)]

    def space_run(self, n: int) -> list[int]:
        """A run of n spaces: the longest piece again and again, then the rest."""
        top = max(self.space_runs)
        rest = merge_greedily(SPACE * (n % top), self.run_rank)[0] if n % top else []
        return [self.space_runs[top]] * (n // top) + [self.space_runs[len(p)] for p in rest]

    def _keep(self, units: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        self.cache.update(zip(units, range(len(self.cache), len(self.cache) + len(units))))
        self.ends = np.concatenate([self.ends, ends + len(self.flat)])
        self.flat = np.concatenate([self.flat, ids.astype(np.int32)])

    def _ids(self, unit: str) -> np.ndarray:
        at = self.cache[unit]
        return self.flat[self.ends[at]:self.ends[at + 1]]

    def learn(self, units: set[str]) -> None:
        """Encode units that are not known yet."""
        spaced = sorted(u for u in units if u[0] == SPACE)
        words = units.difference(spaced)
        words.update(w for w in (u.lstrip(SPACE) for u in spaced) if w and w not in self.cache)
        fresh = sorted(words)
        if fresh:
            self._keep(fresh, *self.encode_words([SPACE + w for w in fresh]))
        alone, parts = self.space_runs[1], []
        for u in spaced:  # more than one space, or spaces only
            word = u.lstrip(SPACE)
            n, ids = len(u) - len(word), np.zeros(0, np.int32)
            if word:
                ids = self._ids(word)
                n, ids = (n, ids[1:]) if ids[0] == alone else (n - 1, ids)
            parts.append(np.concatenate([np.array(self.space_run(n), np.int32), ids]))
        if parts:
            self._keep(spaced, np.concatenate(parts), np.cumsum([len(x) for x in parts]))

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (with the format's space in front of each), one after the other,
        and where each text's end."""
        rows = [_units(t) for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self._forget_words()
        missing = set().union(*rows).difference(self.cache)
        if missing:
            self.learn(missing)
        counts = np.fromiter(map(len, rows), np.int64, len(rows))
        at = np.fromiter(map(self.cache.__getitem__, chain.from_iterable(rows)), np.int64, int(counts.sum()))
        first = self.ends[at]
        sizes = self.ends[at + 1] - first
        stops = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(first - stops[:-1], sizes) + np.arange(stops[-1])]
        return ids, stops[np.cumsum(counts)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        ids, ends = self.encode_flat(texts)
        return np.split(ids, ends[:-1]) if len(texts) else []

    def decode(self, ids) -> str:
        """The text of ids, without the one space that the encoder puts in front, if
        it is there; bytes that are no UTF-8 become U+FFFD."""
        if not len(ids):
            return ""
        return b"".join(map(self.raw.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "replace").removeprefix(" ")


def load(model_file: str = MODEL) -> Codec:
    """Read the pieces of a model file (on the driver)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    kinds = [(sp.is_byte, "byte"), (sp.is_unknown, "unknown"), (sp.is_control, "control")]
    return Codec([(sp.id_to_piece(i), sp.get_score(i), next((k for f, k in kinds if f(i)), "normal"))
                  for i in range(sp.get_piece_size())])


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of about BATCH_CHARS bytes, so that what a step holds is bounded."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > BATCH_CHARS:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def encode(spark: SparkSession, docs: DataFrame, *, text_col: str = "text", out: str = "token_ids",
           model_file: str = MODEL) -> DataFrame:
    """``docs`` with ``out`` (array of piece ids) added."""
    table = spark.sparkContext.broadcast(load(model_file).__getstate__())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        codec = Codec.of(table.value)
        for batch in batches:
            for lo, hi in _slices(batch.column(text_col)):
                part = batch.slice(lo, hi - lo)
                ids, ends = codec.encode_flat([t or "" for t in part.column(text_col).to_pylist()])
                lists = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, out])

    return docs.mapInArrow(run, docs.select("*", F.lit(None).cast("array<int>").alias(out)).schema)


def decode(spark: SparkSession, docs: DataFrame, *, ids_col: str = "token_ids", out: str = "decoded",
           model_file: str = MODEL) -> DataFrame:
    """``docs`` with ``out`` (the text of the ids) added."""
    table = spark.sparkContext.broadcast(load(model_file).__getstate__())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(table.value)
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                texts = [codec.decode(x.values.to_numpy() if x.is_valid else ()) for x in part.column(ids_col)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, out])

    return docs.mapInArrow(run, docs.select("*", F.lit(None).cast("string").alias(out)).schema)
