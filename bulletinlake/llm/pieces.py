"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs whose joined string is a piece, ordered by
score (best first) and then by position (leftmost first). The best pair merges and its neighbours
enter the agenda. Symbols left without a piece become byte pieces. The agendas of many short
runs are kept side by side in arrays, each round taking the best entry of every run; a long run
has a heap of its own, in which stale entries are skipped.

White space is written U+2581 with one in front of the text. A vocabulary whose pieces hold
that sign only as leading run (checked on loading) never merges across the start of such a
run, so a text is encoded run by run and runs seen lately aren't encoded again.

Check: each slice of an Arrow batch has the sentencepiece library encode its distinct new runs
and decode every document's ids; any difference raises. ``check="texts"`` has it encode whole
texts too.

Null text counts as empty: begin and end ids only, decoded to ''. Repeated rows give repeated
results, other columns are ignored, an empty table gives an empty result, and long texts are
encoded whole (a worker remembers at most about ``2 * remember`` runs).
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .scratch import pick

SPACE = "▁"
SLICE = 512  # documents whose runs are held at a time
SHORT, NEVER = 48, float("inf")
_RUNS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Remembered(dict):
    """The entries used lately: when ``most`` are new, the older half of the time goes."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is not None:
            self[key] = value
        return value

    def age(self) -> None:
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()


class PieceModel:
    """Pieces, scores and byte pieces of a model file, with its own encoder and decoder."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        self.ids: dict[str, int] = {}
        self.known: Remembered = Remembered(0)
        self.bytes = [0] * 256
        self.out: list[bytes] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
                self.out.append(bytes([int(piece[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.out.append(b"" if sp.is_control(i) else b" \xe2\x81\x87 ")
            else:
                self.ids[piece] = i
                self.out.append(piece.replace(SPACE, " ").encode("utf-8"))
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"piece {piece!r} holds a space sign after other characters")
        self.cost = {p: -sp.get_score(i) for p, i in self.ids.items() if len(p) > 1}
        self._tables()

    def _tables(self) -> None:
        """Symbols are pieces, by id, and then characters; pairs that merge are sorted by both symbols."""
        size = len(self.out)
        chars = sorted({c for p in self.ids for c in p} - set(self.ids))
        symbols = self.ids | {c: size + i for i, c in enumerate(chars)}
        self.base = size + len(chars)  # a character in no piece is base + its code point
        self.symbol_of = np.arange(0x110000, dtype=np.int64) + self.base
        for s, i in symbols.items():
            if len(s) == 1:
                self.symbol_of[ord(s)] = i
        merges = [(symbols[p[:i]], symbols[p[i:]], c, self.ids[p]) for p, c in self.cost.items() for i in range(1, len(p)) if p[:i] in symbols and p[i:] in symbols]
        pairs = np.array([(a << 32) | b for a, b, _, _ in merges], np.int64)
        order = np.argsort(pairs)
        self.pairs = np.append(pairs[order], np.iinfo(np.int64).max)
        self.pair_cost = np.append(np.array([m[2] for m in merges])[order], NEVER)
        self.pair_piece = np.append(np.array([m[3] for m in merges], np.int64)[order], 0)
        self.pieces = size

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cost and piece of each pair; never, if the two don't merge."""
        key = (left << 32) | right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.pair_cost[at], NEVER), self.pair_piece[at]

    def encode_runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs of up to ``SHORT`` characters, one after the other, and how many each has."""
        lengths = np.fromiter(map(len, runs), np.int64, len(runs))
        points = np.frombuffer("".join(runs).encode("utf-32-le", "surrogatepass"), "<u4")
        sym, run = self.symbol_of[points], np.repeat(np.arange(len(runs)), lengths)
        cost, piece = np.full(len(sym), NEVER), np.zeros(len(sym), np.int64)
        if len(sym) > 1:
            cost[:-1], piece[:-1] = self._look(sym[:-1], sym[1:])
            cost[:-1][run[:-1] != run[1:]] = NEVER
        ended: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            starts = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
            counts = np.diff(np.append(starts, len(run)))
            best = np.minimum.reduceat(cost, starts)
            live = best < NEVER
            if not live.all():
                stays = np.repeat(live, counts)
                ended.append((run[~stays], sym[~stays]))
                sym, run, cost, piece = sym[stays], run[stays], cost[stays], piece[stays]
                best, counts = best[live], counts[live]
                if not len(sym):
                    break
            hit = np.flatnonzero(cost == np.repeat(best, counts))
            at = hit[np.concatenate(([True], run[hit[1:]] != run[hit[:-1]]))]  # the leftmost of each run
            sym[at] = piece[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            cost[at] = cost[at + 1]  # whether another symbol of the run follows is decided below
            sym, run, cost, piece = sym[keep], run[keep], cost[keep], piece[keep]
            at -= np.arange(len(at))
            for i in (at, at - 1):
                i = i[(i >= 0) & (i + 1 < len(sym))]
                c, p = self._look(sym[i], sym[i + 1])
                cost[i], piece[i] = np.where(run[i] == run[i + 1], c, NEVER), p
            if len(sym):
                cost[-1] = NEVER
        if not ended:
            return np.empty(0, np.int64), lengths
        run, sym = (np.concatenate(x) for x in zip(*ended))
        order = np.argsort(run, kind="stable")
        run, sym = run[order], sym[order]
        odd = np.flatnonzero(sym >= self.pieces)
        if len(odd):  # characters without a piece: as their bytes
            spelt = [list(self._bytes_of(int(x))) for x in sym[odd]]
            sizes = np.ones(len(sym), np.int64)
            sizes[odd] = [len(x) for x in spelt]
            run, wide = np.repeat(run, sizes), np.repeat(sym, sizes)
            places = np.repeat(np.cumsum(sizes)[odd] - sizes[odd], sizes[odd]) + np.concatenate([np.arange(len(x)) for x in spelt])
            wide[places] = np.concatenate([np.array(x, np.int64) for x in spelt])
            sym = wide
        return sym, np.bincount(run, minlength=len(runs))

    def _bytes_of(self, symbol: int) -> Iterator[int]:
        point = symbol - self.base if symbol >= self.base else int(np.flatnonzero(self.symbol_of == symbol)[0])
        return (self.bytes[b] for b in chr(point).encode("utf-8"))

    def encode_run(self, run: str) -> list[int]:
        """Ids of one run, by the agenda of adjacent pairs."""
        return self.encode_runs([run])[0].tolist() if len(run) <= SHORT else self._spell(self._merge_long(run))

    def _merge_long(self, run: str) -> list[str]:
        cost = self.cost.get
        symbols: list[str | None] = list(run)
        n = len(symbols)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            c = cost(run[i : i + 2])
            if c is not None:
                agenda.append((c, i, 2))
        heapq.heapify(agenda)
        pop, push = heapq.heappop, heapq.heappush
        while agenda:
            _, i, size = pop(agenda)
            left = symbols[i]
            if left is None:
                continue
            j = nxt[i]
            if j >= n or len(left) + len(symbols[j]) != size:
                continue
            joined = symbols[i] = left + symbols[j]
            symbols[j] = None
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                c = cost(joined + symbols[k])
                if c is not None:
                    push(agenda, (c, i, size + len(symbols[k])))
            h = prv[i]
            if h >= 0:
                c = cost(symbols[h] + joined)
                if c is not None:
                    push(agenda, (c, h, len(symbols[h]) + size))
        return [s for s in symbols if s is not None]

    def _spell(self, symbols: list[str]) -> list[int]:
        ids = self.ids
        try:
            return [ids[s] for s in symbols]
        except KeyError:
            return [i for s in symbols for i in ((ids[s],) if s in ids else [self.bytes[b] for b in s.encode("utf-8")])]

    def runs(self, text: str) -> list[str]:
        return _RUNS.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces and bytes joined, one leading space taken away.

        Bytes that are no UTF-8 become U+FFFD each, as the library has it.
        """
        raw = b"".join([self.out[i] for i in ids])
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            text = self.library.decode(ids)
            return text
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=4)
def load(path: str) -> PieceModel:
    return PieceModel(path)


def _encoder(path: str, remember: int, check: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        known = model.known  # kept by the worker from task to task
        known.most = remember
        begin, end = np.array([model.bos], "<u4").tobytes(), np.array([model.eos], "<u4").tobytes()
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            texts = [t or "" for t in batch["text"].to_pylist()]
            split = [model.runs(t) for t in texts]
            known.age()
            new = list({r for runs in split for r in runs if known[r] is None})
            short = [r for r in new if len(r) <= SHORT]
            ids, sizes = model.encode_runs(short)
            raw, ends = ids.astype("<u4").tobytes(), np.cumsum(4 * sizes).tolist()
            for r, a, b in zip(short, [0, *ends], ends):
                known[r] = raw[a:b]
            for r in new:
                if len(r) > SHORT:
                    known[r] = np.array(model.encode_run(r), "<u4").tobytes()
            # the library is given runs without their first sign, and has no ids for no text
            asked = [r for r in new if r != SPACE]
            wanted = model.library.encode([r[1:].replace(SPACE, " ") for r in asked], num_threads=1) if asked else []
            theirs = np.fromiter(chain.from_iterable(wanted), "<u4").tobytes()
            if b"".join([known[r] for r in asked]) != theirs or [len(known[r]) // 4 for r in asked] != list(map(len, wanted)):
                r, w = next((r, w) for r, w in zip(asked, wanted) if np.frombuffer(known[r], "<u4").tolist() != w)
                raise AssertionError(f"the library has {r!r} as {w}, the agenda as {np.frombuffer(known[r], '<u4').tolist()}")
            rows = []
            for doc_id, text, runs in zip(batch["doc_id"].to_pylist(), texts, split):
                raw = b"".join([begin, *[known[r] for r in runs], end])
                ids = np.frombuffer(raw, "<u4").tolist()
                decoded = model.decode(ids)
                if decoded != model.library.decode(ids) or (check == "texts" and ids != model.library.encode(text, add_bos=True, add_eos=True)):
                    raise AssertionError(f"document {doc_id} differs from the library")
                rows.append((doc_id, raw, decoded))
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.string()))], names=["doc_id", "ids", "decoded"])

    return run


def encode_and_decode(docs: DataFrame, model_path: str, remember: int = 800_000, check: str = "runs") -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, ids, decoded)``: little-endian 32-bit ids with begin and end."""
    rows = pick(docs, doc_id="doc_id", text="text")
    return rows.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(_encoder(model_path, remember, check), "doc_id long, ids binary, decoded string")


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode_and_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.selectExpr("doc_id", "cast(length(ids) / 4 as long) as n_tokens", "sha2(ids, 256) as ids_sha256", "sha2(cast(decoded as binary), 256) as decoded_sha256")
