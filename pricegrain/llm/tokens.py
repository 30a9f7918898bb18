"""Token ids by a public byte-level BPE tokenizer, with a memo of the pieces already encoded."""

from __future__ import annotations

import gc
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pricegrain.llm.shared import kept_for

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
END_ID = 2
#: Pieces kept in the memo; beyond them only those of the texts at hand stay. This bounds memory only, results don't depend on it.
MEMO_PIECES = 400_000
#: New pieces encoded as one text.
TOGETHER = 64
_STOPS = ".,"
_END = np.array([END_ID], "<u4").tobytes()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _taken(store: np.ndarray, start: np.ndarray, n: np.ndarray, kind: type = np.int64) -> np.ndarray:
    """Runs of store, of which each begins at start and has n numbers, one after the other."""
    if not len(n):
        return store[:0]
    ends = np.cumsum(n, dtype=kind)
    return store[np.repeat(start.astype(kind) - ends + n.astype(kind), n) + np.arange(ends[-1], dtype=kind)]


class Encoder:
    """Encodes texts with the tokenizers library, add_special_tokens=False.

    A byte-level BPE cuts texts before each single space that follows no white space, whatever stands
    around it, so the pieces between can be encoded once and remembered. New pieces are encoded
    together as one text and told apart by the byte lengths of their tokens. A full stop or comma after
    a letter is a token of its own. Texts with other white space beside a space are encoded whole.

    The memo is an Arrow array of pieces, which Arrow looks up, and one array of all their ids: a piece
    that is known does not become a Python object.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.bytes_of[i] = len(token)
        self.added = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.stops = dict(zip(_STOPS, self._ids(list(_STOPS)), strict=True))
        self.memo = pa.array([], pa.large_string())
        #: Ids of a space and each piece of the memo: where they begin in the store and how many; -1 if the piece must be seen with what is around it.
        self.store, self.start, self.size = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.firsts: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where different pieces stand in the memo; new ones are learnt."""
        at = pc.index_in(pieces, value_set=self.memo)
        if len(self.memo) > MEMO_PIECES:
            rows = at.drop_null().to_numpy()
            self.store = _taken(self.store, self.start[rows], np.maximum(self.size[rows], 0))
            self.memo, self.size = self.memo.take(pa.array(rows)), self.size[rows]
            self.start = np.cumsum(np.maximum(self.size, 0), dtype=np.int64) - np.maximum(self.size, 0)
            at = pc.index_in(pieces, value_set=self.memo)
        if not at.null_count:
            return at.to_numpy()
        missing, before = at.is_null(), len(self.memo)
        self._learn(pieces.filter(missing))
        places, missing = at.fill_null(0).to_numpy().copy(), missing.to_numpy(zero_copy_only=False)
        places[missing] = before + np.arange(missing.sum())
        return places

    def _learn(self, new: pa.Array) -> None:
        """Put new pieces into the memo, in their order."""
        # No piece has a space, so all can become one Python string that is cut again, which is the quickest way.
        together = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(new)]), new), pa.scalar(" ", pa.large_string()))[0].as_py()
        pieces, plain, stopped = together.split(" "), [], []
        added, ids = [t for t in self.added if t in together], {}
        for p in pieces:
            if p.isalpha():
                plain.append(p)
            elif not p or p.strip() is not p or (added and any(t in p for t in added)):
                ids[p] = None
            elif p[-1] in _STOPS and p[-2:-1].isalpha():
                stopped.append(p)
            else:
                plain.append(p)
        bases = list({p[:-1] for p in stopped}.difference(plain))
        for p, at in zip(bases, pc.index_in(pa.array(bases, pa.large_string()), value_set=self.memo).to_pylist(), strict=True):
            if at is not None:
                ids[p] = self.store[self.start[at] : self.start[at] + self.size[at]].tobytes()
        bases = [p for p in bases if p not in ids]
        ids.update(self._learnt_together(plain + bases))
        for p in stopped:
            ids[p] = ids[p[:-1]] + self.stops[p[-1]]
        found = [ids[p] for p in pieces + bases]
        size = np.fromiter((-1 if x is None else len(x) // 4 for x in found), np.int32, len(found))
        ends = len(self.store) + np.cumsum(np.maximum(size, 0), dtype=np.int64)
        self.memo = pa.concat_arrays([self.memo, new, pa.array(bases, pa.large_string())])
        self.start, self.size = np.r_[self.start, ends - np.maximum(size, 0)], np.r_[self.size, size]
        self.store = np.r_[self.store, np.frombuffer(b"".join(x or b"" for x in found), "<u4")]

    def _learnt_together(self, new: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each piece and the ids of a space and it, encoded so many to a text and told apart by the tokens' byte lengths."""
        if not new:
            return iter(())
        texts = [" " + " ".join(new[i : i + TOGETHER]) for i in range(0, len(new), TOGETHER)]
        ids = np.frombuffer(b"".join(self._ids(texts)), "<u4")
        ends, raw = np.cumsum(self.bytes_of[ids]), "".join(texts).encode()
        want = np.r_[np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)[1:], len(raw)]
        cut = np.searchsorted(ends, want)
        if not np.array_equal(ends[cut], want):
            raise ValueError("not a byte-level tokenizer that cuts texts before spaces")
        raw, cut = ids.tobytes(), ((cut + 1) * 4).tolist()
        return zip(new, (raw[a:b] for a, b in zip([0, *cut], cut)), strict=True)  # noqa: B905

    def _heads(self, firsts: list[str]) -> list[bytes]:
        """Ids of the texts' first pieces, before which no space stands."""
        if len(self.firsts) > MEMO_PIECES // 8:
            self.firsts = {}
        new = list(set(firsts).difference(self.firsts))
        self.firsts.update(zip(new, self._ids(new), strict=True))
        return list(map(self.firsts.__getitem__, firsts))

    def encode(self, texts: pa.Array, ended: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each text has; ended: with the end id after each.

        The tables of pieces hold no cycles, so Python's garbage collector, which would visit them again
        and again, pauses meanwhile.
        """
        running = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts, ended)
        finally:
            if running:
                gc.enable()

    def _encode(self, texts: pa.Array, ended: bool) -> tuple[np.ndarray, np.ndarray]:
        """Arrow cuts the texts, numbers the different pieces and looks these up."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        # One more piece at the end of each text holds the place of the end id.
        cut = pc.split_pattern(pc.binary_join_element_wise(texts, "", " ") if ended else texts, " ")
        at = cut.offsets.to_numpy()
        at, last, values = at[:-1] - at[0], at[1:] - at[0] - 1, cut.values.slice(at[0], at[-1] - at[0])
        firsts = values.take(pa.array(at)).to_pylist()
        coded = values.dictionary_encode()
        known, place = self._places(coded.dictionary.cast(pa.large_string())), coded.indices.to_numpy()
        start, size = self.start[known], self.size[known]
        whole = (size < 0)[place]
        if ended:
            whole[last] = False
        whole[at] = [t[-1:].isspace() or any(x in t for x in self.added) for t in firsts]
        whole = np.logical_or.reduceat(whole, at)  # texts with a piece that must be seen with what is around it
        heads = self._heads(firsts)
        if whole.any():
            rows = np.flatnonzero(whole)
            for i, ids in zip(rows.tolist(), self._ids(texts.take(pa.array(rows)).to_pylist()), strict=True):
                heads[i] = ids
        # Behind the ids of the memo stand those of heads, and the end id.
        heads.append(_END)
        more = np.fromiter(map(len, heads), np.int32, len(heads)) // 4
        store = np.r_[self.store, np.frombuffer(b"".join(heads), "<u4")]
        first = len(store) - more[::-1].cumsum(dtype=np.int64)[::-1]
        kind = np.int32 if len(store) + len(texts.buffers()[2]) < 1 << 31 else np.int64
        start, n = start.astype(kind)[place], np.maximum(size, 0)[place]
        if whole.any():
            n[np.repeat(whole, np.diff(np.r_[at, len(place)]))] = 0
        start[at], n[at] = first[:-1], more[:-1]
        if ended:
            start[last], n[last] = first[-1], more[-1]
        return _taken(store, start, n, kind), np.add.reduceat(n, at, dtype=np.int64)


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, which a worker keeps while it has tasks that need one."""
    kept = kept_for("tokens")
    if path not in kept:
        kept.clear()
        kept[path] = Encoder(path)
    return kept[path]
