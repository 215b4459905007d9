"""BPE encoding and decoding by speculation and verification.

Every word is first cut by greedy longest match, all words of a batch at once. A cut equals the result of the merges
if, and only if, each adjacent pair of tokens would stay apart were it merged alone; that is checked for all distinct
pairs of the batch at once. Only words with a failing pair go through the exact merges.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from framequery.llm.words import freed, gather, join_rows, rebatched, split_words, to_batches, unique_words

NEVER = np.int64(1 << 40)
#: Longer words take the exact path at once; the speculative walk is one step a byte for a whole batch.
SPECULATE_BYTES = 64
#: Below this code point Python's tables and the tokenizer's agree on lower case, letters and digits (tested).
PLAIN_BELOW = 0x250
END = "</w>"
#: Text that is encoded at once.
BATCH_BYTES = 3 << 20
#: Words that make their merges together.
MERGED_AT_ONCE = 5_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


class WordBpe:
    """A byte-level BPE with word ends, read from a tokenizer file; one instance a worker process."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.strings = [""] * size
        for s, i in [*vocab.items(), *self.specials.items()]:
            self.strings[i] = s
        letters = byte_letters()
        self.of_letter = {c: b for b, c in enumerate(letters)}
        self.base = [(vocab[c], vocab[c + END]) for c in letters]
        self.piece = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.piece_or_line = regex.compile(rf"\n|{self.piece.pattern}")
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)")

        self.left, self.right = np.full(size, -1), np.full(size, -1)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if (x, y) not in self.merges:
                self.merges[x, y] = (rank, z)
                if self.left[z] < 0:
                    self.left[z], self.right[z] = x, y
        keys = np.array([x << 20 | y for x, y in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.array([r for r, _ in self.merges.values()], np.int64)[order]
        self.pair_results = np.array([z for _, z in self.merges.values()], np.int64)[order]
        self._spines(size)
        self._trie(vocab)

    def _spines(self, size: int) -> None:
        """Of each token, the symbols that stand at its right and left edge in turn, each with the rank that ends it."""
        right: list[list[int]] = [[i] for i in range(size)]
        left: list[list[int]] = [[i] for i in range(size)]
        rank = np.full(size, -1, np.int64)
        for (x, y), (r, z) in self.merges.items():
            if self.left[z] == x and self.right[z] == y:
                rank[z] = r
                right[z], left[z] = [*right[y], z], [*left[x], z]
        if any(rank[x] >= r or rank[y] >= r for (x, y), (r, _) in self.merges.items()):
            raise ValueError("merges whose parts come later than they do can't be verified pair by pair")
        self.rank = rank

        def table(chains: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
            deep = max(map(len, chains))
            symbols, ends = np.full((size, deep), -1, np.int32), np.full((size, deep), NEVER)
            for i, chain in enumerate(chains):
                symbols[i, : len(chain)] = chain
                ends[i, : len(chain) - 1] = rank[chain[1:]]
            return symbols, ends

        self.right_symbols, self.right_ends = table(right)
        self.left_symbols, self.left_ends = table(left)

    def apart(self, a: np.ndarray, b: np.ndarray, below_top: bool = False) -> np.ndarray:
        """Whether the merges leave a | b apart. below_top: leave out the merge of the whole pair itself."""
        ok = np.ones(len(a), bool)
        todo = np.arange(len(a))
        i, j = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        while len(todo):
            x, y = self.right_symbols[a[todo], i[todo]], self.left_symbols[b[todo], j[todo]]
            x_ends, y_ends = self.right_ends[a[todo], i[todo]], self.left_ends[b[todo], j[todo]]
            rank = self.ranks(x, y)
            top = (x_ends == NEVER) & (y_ends == NEVER)
            # Of equal ranks the leftmost merges first: x goes to its left partner, y comes to x.
            joined = (rank < x_ends) & (rank <= y_ends) & (rank < NEVER)
            if below_top:
                joined &= ~top
            ok[todo[joined]] = False
            step_x = x_ends <= y_ends
            i[todo] += step_x
            j[todo] += ~step_x
            todo = todo[~(top | joined)]
        return ok

    def _trie(self, vocab: dict[str, int]) -> None:
        merged = np.flatnonzero(self.left >= 0)
        good = set(merged[self.apart(self.left[merged], self.right[merged], below_top=True)].tolist())
        nodes: dict[int, int] = {}
        accept: list[list[int]] = [[-1, -1]]
        for s, i in vocab.items():
            if i not in good and self.left[i] >= 0 or s in self.specials:
                continue
            ends = s.endswith(END) and len(s) > len(END)
            node = 0
            for c in s[: -len(END)] if ends else s:
                key = node << 8 | self.of_letter[c]
                if key not in nodes:
                    nodes[key] = len(accept)
                    accept.append([-1, -1])
                node = nodes[key]
            if self.left[i] >= 0 or len(s) <= 1 + len(END) * ends:
                accept[node][ends] = i
        keys = np.array(list(nodes), np.int64)
        order = np.argsort(keys)
        self.edges, self.targets = keys[order], np.array(list(nodes.values()), np.int64)[order]
        self.accept = np.array(accept, np.int64)

    def merged(self, word: bytes) -> list[int]:
        """The exact merges of one word: lowest rank first, leftmost first among equals; O(n log n)."""
        if not word:
            return []
        ids = [self.base[b][k == len(word) - 1] for k, b in enumerate(word)]
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap = [(m[0], k, ids[k], ids[k + 1]) for k in range(len(ids) - 1) if (m := self.merges.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, x, y = heapq.heappop(heap)
            n = after[k]
            if ids[k] != x or n < 0 or ids[n] != y:
                continue
            ids[k], ids[n] = self.merges[x, y][1], -1
            after[k] = after[n]
            if after[k] >= 0:
                before[after[k]] = k
            for p, q in ((before[k], k), (k, after[k])):
                if p >= 0 and q >= 0 and (m := self.merges.get((ids[p], ids[q]))):
                    heapq.heappush(heap, (m[0], p, ids[p], ids[q]))
        return [i for i in ids if i >= 0]

    def greedy(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest-match tokens of all words (data, offsets) at once: flat ids and offsets."""
        n = len(offsets) - 1
        todo = np.flatnonzero(np.diff(offsets) > 0)
        start, end = offsets[:-1].copy(), offsets[1:]
        at, node = start.copy(), np.zeros(n, np.int64)
        token, stop = np.full(n, -1, np.int64), start.copy()
        words, tokens = [], []
        while len(todo):
            alive = at[todo] < end[todo]
            key = node[todo] << 8 | data[np.minimum(at[todo], len(data) - 1)]
            edge = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            alive &= self.edges[edge] == key
            go = todo[alive]
            node[go] = self.targets[edge[alive]]
            at[go] += 1
            found = self.accept[node[go], (at[go] == end[go]).astype(np.int64)]
            hit = found >= 0
            token[go[hit]], stop[go[hit]] = found[hit], at[go[hit]]
            done = todo[~alive]
            if len(done):
                words.append(done)
                tokens.append(token[done])
                start[done] = at[done] = stop[done]
                node[done], token[done] = 0, -1
                over = start >= end
                todo = todo[~over[todo]]
        word = np.concatenate([*words, np.zeros(0, np.int64)])
        order = np.argsort(word, kind="stable")
        counts = np.bincount(word, minlength=n)
        return np.concatenate([*tokens, np.zeros(0, np.int64)])[order], np.concatenate([[0], np.cumsum(counts)])

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct, already normalised words: flat ids and offsets."""
        sizes = np.array([len(w) for w in words], np.int64)
        tried = sizes <= SPECULATE_BYTES
        data = np.frombuffer(b"".join(w for w, t in zip(words, tried, strict=True) if t) + b"\0", np.uint8)
        ids, offsets = self.greedy(data, np.concatenate([[0], np.cumsum(sizes * tried)]))
        word = np.repeat(np.arange(len(words)), np.diff(offsets))
        pairs = np.flatnonzero(word[1:] == word[:-1])
        keys, back = np.unique(ids[pairs] << 20 | ids[pairs + 1], return_inverse=True)
        ok = self.apart(keys >> 20, keys & 0xFFFFF)
        exact = ~tried
        exact[word[pairs[~ok[back]]]] = True
        if not exact.any():
            return ids, offsets
        starts, counts = offsets[:-1].copy(), np.diff(offsets)
        flat, at = [ids], len(ids)
        long = np.flatnonzero(exact & ~tried)
        for k in long:
            own = np.array(self.merged(words[k]), np.int64)
            starts[k], counts[k], at = at, len(own), at + len(own)
            flat.append(own)
        short = np.flatnonzero(exact & tried)
        short = short[np.argsort(sizes[short], kind="stable")]
        for rows in np.array_split(short, -(-len(short) // MERGED_AT_ONCE)) if len(short) else []:
            own, own_offsets = self.merged_together([words[k] for k in rows], sizes[rows])
            starts[rows], counts[rows] = at + own_offsets[:-1], np.diff(own_offsets)
            flat.append(own)
            at += len(own)
        out = np.concatenate([[0], np.cumsum(counts)])
        return np.concatenate(flat)[np.arange(out[-1]) + np.repeat(starts - out[:-1], counts)], out

    def ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, NEVER where there is none."""
        key = x.astype(np.int64) << 20 | y
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (x >= 0) & (y >= 0), self.pair_ranks[at], NEVER)

    def merged_together(self, words: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The exact merges of many short words of like length: in each round every word makes its next merge."""
        n, most = len(words), int(sizes.max())
        data = np.frombuffer(b"".join(w.ljust(most, b"\0") for w in words), np.uint8).reshape(n, most)
        base = np.array(self.base, np.int64)
        ids = np.where(np.arange(most) < sizes[:, None], base[data, 0], -1)
        ids[np.arange(n), sizes - 1] = base[data[np.arange(n), sizes - 1], 1]
        ids = np.concatenate([ids, np.full((n, 2), -1)], axis=1)
        rank = np.full((n, most + 2), NEVER)
        rank[:, :-1] = self.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, most + 1)
        todo = np.arange(n)
        columns = np.arange(most + 1)
        while len(todo):
            k = rank[todo].argmin(axis=1)
            go = rank[todo, k] < NEVER
            todo, k = todo[go], k[go]
            if not len(todo):
                break
            joined = self.pair_results[np.searchsorted(self.pair_keys, ids[todo, k] << 20 | ids[todo, k + 1])]
            # Close the gap at k + 1, then rank the pairs on both sides of the new symbol anew.
            take = columns + (columns >= k[:, None] + 1)
            ids[todo[:, None], columns] = np.take_along_axis(ids[todo], take, axis=1)
            rank[todo[:, None], columns] = np.take_along_axis(rank[todo], take, axis=1)
            ids[todo, k] = joined
            rank[todo, k] = self.ranks(joined, ids[todo, k + 1])
            inner = k > 0
            rank[todo[inner], k[inner] - 1] = self.ranks(ids[todo[inner], k[inner] - 1], joined[inner])
        full = ids >= 0
        return ids[full], np.concatenate([[0], np.cumsum(full.sum(axis=1))])

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(self.path)
        t.no_truncation()
        t.no_padding()
        return t

    def pieces(self, chunk: str) -> list[str]:
        """The words that the merges see of one run without white space, special tokens aside."""
        if chunk.isascii() or max(chunk) < chr(PLAIN_BELOW):
            text = chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk)
            return self.piece.findall("".join(c.lower() for c in text))
        unmapped = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))
        return [bytes(self.of_letter[c] for c in p).decode("utf-8") for p, _ in unmapped]

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct white-space-free runs: flat ids and offsets."""
        odd = [k for k, c in enumerate(chunks) if not c.isascii() and max(c) >= chr(PLAIN_BELOW) or "<|" in c]
        is_odd = np.zeros(len(chunks), bool)
        is_odd[odd] = True
        plain = [c for c, o in zip(chunks, is_odd.tolist(), strict=True) if not o]
        text = unicodedata.normalize("NFC", "\n".join(plain))
        lowered = text.lower() if "İ" not in text else "".join(c.lower() for c in text)
        flat = self.piece_or_line.findall(lowered)
        if plain:
            flat.append("\n")
        for k in odd:
            at = 0
            for m in self.special.finditer(chunks[k]):
                flat += [*(self.pieces(chunks[k][at : m.start()]) if m.start() > at else []), m[0]]
                at = m.end()
            flat += [*(self.pieces(chunks[k][at:]) if at < len(chunks[k]) else []), "\n"]
        distinct, index = unique_words(pa.array(flat, pa.large_string()))
        words = distinct.to_pylist()
        line = np.zeros(len(words) + 1, bool)
        apart = {k: self.specials[w] for k, w in enumerate(words) if w in self.specials} if odd else {}
        line[[k for k, w in enumerate(words) if w == "\n"]] = True
        ids, offsets = self.encode_words([b"" if w == "\n" or k in apart else w.encode("utf-8") for k, w in enumerate(words)])
        if apart:  # special tokens join the table as words of one id
            where = np.array(list(apart))
            ids = np.insert(ids, offsets[where], list(apart.values()))
            offsets = offsets + np.concatenate([[0], np.cumsum(np.isin(np.arange(len(words)), where))])
        values, piece_offsets = gather(ids, offsets, index)
        ends = np.flatnonzero(line[index])
        run_offsets = np.concatenate([[0], piece_offsets[ends]])
        if not odd:
            return values, run_offsets
        place = np.empty(len(chunks), np.int64)
        place[np.concatenate([np.flatnonzero(~is_odd), np.array(odd)])] = np.arange(len(chunks))
        return gather(values, run_offsets, place)


@functools.lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def encode_texts(texts: pa.Array, encode_chunks) -> tuple:
    """Encode whole texts over the distinct runs of a batch: flat ids, offsets of texts, then the runs' table."""
    flat, text_offsets = split_words(texts)
    distinct, index = unique_words(flat)
    ids, offsets = encode_chunks(distinct.to_pylist())
    values, run_offsets = gather(ids, offsets, index)
    return values, run_offsets[text_offsets], ids, offsets, np.stack([text_offsets[:-1], text_offsets[1:]]), index


def encode_decode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Encode and decode every whole text: (id, n_tokens, ids ARRAY<INT>, decoded).

    NULL and empty texts have no ids and an empty decoded text. A map over partitions: no shuffle, and memory is
    bounded by a batch of BATCH_BYTES of text (and the longest text). Repeated rows and NULL ids come out as they are;
    other columns aren't read.
    """
    key = docs.schema[id_col].dataType.simpleString()
    return _mapped(docs, tokenizer_path, text_col, id_col, f"{id_col} {key}, n_tokens long, ids array<int>, decoded string", False)


def encode_decode_digests(
    docs: DataFrame, tokenizer_path: str, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """As encode_decode, with SHA-256 of the ids (little-endian uint32) and of the decoded text in place of both."""
    key = docs.schema[id_col].dataType.simpleString()
    return _mapped(docs, tokenizer_path, text_col, id_col, f"{id_col} {key}, n_tokens long, ids_sha256 string, decoded_sha256 string", True)


def _mapped(docs: DataFrame, path: str, text_col: str, id_col: str, schema: str, digests: bool) -> DataFrame:
    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        strings = pa.array(bpe.strings, pa.large_string())
        for table in rebatched(batches, BATCH_BYTES):
            texts = table.column(1).combine_chunks()
            values, offsets, ids, id_offsets, spans, index = encode_texts(texts, bpe.encode_chunks)
            runs = join_rows(strings.take(pa.array(ids)), id_offsets)
            # A run may have no ids (white space that only Unicode knows); it leaves no blank either.
            full = np.diff(id_offsets)[index] > 0
            kept = np.concatenate([[0], np.cumsum(full)])
            ends = np.concatenate([kept[spans[0]], kept[spans[1][-1:]]])
            decoded = join_rows(runs.take(pa.array(index[full])), ends)
            n = pa.array(np.diff(offsets))
            if digests:
                raw = values.astype("<u4")
                hashed = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                out = [pa.array(hashed), pa.array([hashlib.sha256(memoryview(s.as_buffer())).hexdigest() for s in decoded])]
            else:
                out = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32))), decoded.cast(pa.string())]
            names = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
            yield from to_batches(pa.table([table.column(0), n, *out], names=[id_col, "n_tokens", *names]))

    return docs.select(id_col, text_col).mapInArrow(run, schema)
