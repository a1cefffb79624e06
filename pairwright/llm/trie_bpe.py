"""BPE encoding of distinct words by one walk over their trie.

In a BPE encoding every prefix of a word that ends with a token of it has exactly the tokens
before as its own encoding.  So the last token of each prefix is all that must be kept: the
last token of a longer prefix is the one suffix token t for which the last token before t and t
stay apart when they are encoded together.  Words are put into a trie, which a worker keeps from one slice of
texts to the next; a depth-first walk over the new words hands the last tokens down, and a prefix that many words
share, in whatever slices, is encoded once.

Decoding goes from ids alone: each id is looked up in the vocabulary, ids that it does not have are
passed over, and the tokens are joined as the file's decoder joins them.

Defined cases: null and empty texts have no ids and decode to the empty text; special tokens'
strings in a text become their ids, as the tokenizers library has it; very long texts and
repeated rows are encoded like any others; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pairwright.llm.common import KEPT, doc_texts, slices, table
from pairwright.llm.tokens import tokenizer_path

END, NEVER = "</w>", 1 << 60
LETTERS = "a-zªµºß-öø-ÿāăąćĉċčďđēĕėęěĝğġģĥħĩīĭįıĳĵķĸĺļľŀłńņňŉŋōŏőœŕŗřśŝşšţťŧũūŭůűųŵŷźżžſ"
NUMERIC = "0-9²³¹¼-¾"
#: How the file's pre-tokenizer splits lower-cased texts of the characters that PLAIN admits.
WORDS = re.compile(rf"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{NUMERIC}]|[^\s{LETTERS}{NUMERIC}]+")
NOT_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ňŊ-ſ]")
#: What a worker keeps, for speed alone: bytes of words and their ids, pairs of tokens, nodes of the trie, down to which depth; and the longest word that is kept.
KEEP_BYTES, KEEP_PAIRS, NODES, DEPTH, LONG_WORD = 96 << 20, 500_000, 400_000, 48, 1_000


def byte_letters() -> list[str]:
    """The character that stands for each byte: itself where it prints, else one from U+0100 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class TrieEncoder:
    """Encodes words (strings of byte letters) of one word-end BPE vocabulary."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.vocab, self.ranks = vocab, {tuple(m): i for i, m in enumerate(merges)}
        self.longest = max(map(len, vocab))
        #: for each token, whether it stays apart from each token seen before it
        self.state: dict[str, dict[str, bool]] = {t: {} for t in vocab}
        self.kept = 0
        self.built: dict[str, tuple[bool, bool, list, list]] = {}
        #: the trie: the node that a node and a letter lead to, and the last token of each node's prefix
        self.children: dict[int, int] = {}
        self.ends: list[str] = [""]
        self.walked = 0  # prefixes that were encoded

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE: the pair of least rank is joined, the leftmost first, until none is left."""
        while len(symbols) > 1:
            rank, at = min((self.ranks.get(p, NEVER), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == NEVER:
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    @staticmethod
    def symbols(text: str) -> list[str]:
        if not text.endswith(END):
            return list(text)
        text = text[: -len(END)]
        return [*text[:-1], text[-1] + END]

    def edges(self, token: str) -> tuple[bool, bool, list, list]:
        """How a token is built, seen from its two ends.

        Whether it encodes to itself; whether ranks only rise while it is built; the symbols
        that stand at its right end, and those at its left end, each with the rank of the merge
        that takes it in (infinite for the token itself).
        """
        known = self.built.get(token)
        if known is None:
            symbols, right, left, rising, level = self.symbols(token), [], [], True, -1
            while len(symbols) > 1:
                rank, at = min((self.ranks.get(p, NEVER), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
                if rank == NEVER:
                    break
                rising, level = rising and rank >= level, rank
                if at == 0:
                    left.append((symbols[0], rank))
                if at == len(symbols) - 2:
                    right.append((symbols[-1], rank))
                symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
            known = self.built[token] = (len(symbols) == 1, rising, [*right, (symbols[-1], NEVER)], [*left, (symbols[0], NEVER)])
        return known

    def _fits(self, before: str, token: str) -> bool:
        """Whether `before` and `token` remain two tokens when encoded together ('' before: token alone)."""
        alone, rising, _, lefts = self.edges(token)
        if not before or not alone:
            return alone
        alone, rose, rights, _ = self.edges(before)
        if not (rising and rose):  # merges do not follow their ranks: encode both together
            return self.merged([*self.symbols(before), *self.symbols(token)]) == [before, token]
        i = j = 0
        while True:  # merges at the border in the order of their ranks; of equal ones the leftmost is first
            (a, left), (b, right) = rights[i], lefts[j]
            rank = self.ranks.get((a, b), NEVER)
            if rank < left and rank <= right and rank != NEVER:
                return False
            if left == right == NEVER:
                return True
            if left <= right:
                i += 1
            else:
                j += 1

    def encode(self, words: list[str]) -> dict[str, list[str]]:
        """Tokens of each distinct word, each word not empty.

        Words come sorted, so that they are inserted in the trie's depth-first order: a word goes on from where it branches off the one
        before it.  lasts holds, along the path from the root, the last token of each prefix: it is the node's where there is one, and
        else follows from those above it.  Below DEPTH there are no nodes.
        """
        if len(self.ends) > NODES:
            self.children.clear()
            del self.ends[1:]
        found: dict[str, list[str]] = {}
        lasts = [""] * (1 + max(map(len, words), default=0))
        state, longest, before, path = self.state, self.longest, "", [0]
        children, ends = self.children, self.ends
        for word in sorted(words):
            n, at = len(word), 0
            for a, b in zip(before, word[:-1], strict=False):
                if a != b:
                    break
                at += 1
            at = min(at, len(before) - 1) if before else 0  # a word's last letter is not a node of its prefix
            before = word
            del path[at + 1 :]
            node = path[at]
            for end in range(at + 1, n):
                step = node << 21 | ord(word[end - 1])
                known = children.get(step) if node >= 0 else None
                if known is not None:
                    node = known
                    path.append(node)
                    lasts[end] = ends[node]
                    continue
                for start in range(end - longest if end > longest else 0, end):
                    fits = state.get(word[start:end])
                    if fits is not None:
                        ok = fits.get(lasts[start])
                        if ok is None:
                            ok = self._learn(lasts[start], word[start:end])
                        if ok:
                            lasts[end] = word[start:end]
                            break
                else:
                    raise ValueError(f"no token ends {word[:end]!r}")
                self.walked += 1
                if node >= 0 and end <= DEPTH:
                    children[step] = node = len(ends)
                    ends.append(lasts[end])
                else:
                    node = -1
                path.append(node)
            ended = word + END
            for start in range(n - longest if n > longest else 0, n):
                fits = state.get(ended[start:])
                if fits is not None:
                    ok = fits.get(lasts[start])
                    if self._learn(lasts[start], ended[start:]) if ok is None else ok:
                        break
            else:
                raise ValueError(f"no token ends {word!r}")
            tokens = [ended[start:]]
            while start:
                tokens.append(lasts[start])
                start -= len(lasts[start])
            found[word] = tokens[::-1]
        return found

    def _learn(self, before: str, token: str) -> bool:
        self.kept += 1
        if self.kept > KEEP_PAIRS:
            self.kept = 0
            for fits in self.state.values():
                fits.clear()
        ok = self.state[token][before] = self._fits(before, token)
        return ok


class TextEncoder:
    """Whole texts to ids and back, for a file of the tokenizers library with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:  # a file of the installation, the same on all executors
            stored = json.load(f)
        model = stored["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.trie = TrieEncoder(model["vocab"], merges)
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.letters = dict(enumerate(byte_letters()))
        self.id_bytes = {t: i.to_bytes(4, "little") for t, i in model["vocab"].items()}
        self.ids: dict[str, bytes] = {}
        self.held = 0  # bytes of ids, about
        every = {**{i: t for t, i in model["vocab"].items()}, **{i: t for t, i in self.special.items()}}
        #: token of each id, None where there is none
        self.tokens = np.array([every.get(i) for i in range(max(every) + 1)], dtype=object)
        self.gaps = len(every) < len(self.tokens)

    def _words(self, text: str) -> list[str]:
        """Words as the library splits them, plain text or in byte letters (marked by a leading NUL)."""
        if NOT_PLAIN.search(text):
            text = self.library.normalizer.normalize_str(text)
            return ["\0" + w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return WORDS.findall(text.lower())

    def _learn(self, new: list[str]) -> None:
        spelled = [w[1:] if w[0] == "\0" else w if w.isascii() else "".join(map(self.letters.__getitem__, w.encode())) for w in new]
        tokens = self.trie.encode(list(dict.fromkeys(spelled)))
        for w, own in zip(new, map(tokens.__getitem__, spelled), strict=True):
            self.ids[w] = ids = b"".join(map(self.id_bytes.__getitem__, own))
            self.held += 2 * len(w) + len(ids) + 200  # about what Python holds for it

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, four bytes each."""
        cut = [self.split.split(t) if "<|" in t else (t,) for t in texts]
        parts = [[self.special[p] if p in self.special else self._words(p) for p in one if p] for one in cut]
        words = [w for one in parts for p in one if not isinstance(p, int) for w in p]
        fresh = set(words).difference(self.ids)
        if self.held > KEEP_BYTES:
            self.ids.clear()
            self.held, fresh = 0, set(words)
        self._learn(sorted(fresh))
        out = []
        for one in parts:
            ids = []
            for p in one:
                if isinstance(p, int):
                    ids.append(p.to_bytes(4, "little"))
                else:
                    ids.extend(map(self.ids.__getitem__, p))
            out.append(b"".join(ids))
        for w in [w for w in fresh if len(w) > LONG_WORD]:
            self.held -= 2 * len(w) + len(self.ids.pop(w)) + 200
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text that ids stand for, as the library's decode(ids, skip_special_tokens=False) gives it."""
        if len(ids) and int(ids.max()) >= len(self.tokens):
            ids = ids[ids < len(self.tokens)]
        tokens = self.tokens[ids].tolist()
        if self.gaps:
            tokens = [t for t in tokens if t is not None]
        return " ".join(tokens) if self.library.decoder is None else self.library.decoder.decode(tokens)


_LOADED: dict[str, TextEncoder] = {}


def _free() -> bool:
    some = bool(_LOADED)
    _LOADED.clear()
    return some


KEPT["trie"] = _free


def text_encoder(path: str) -> TextEncoder:
    """One encoder per worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = TextEncoder(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int> of every text; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(path)
        for part in slices(batches, keep="trie"):
            ids = [np.frombuffer(x, "<i4") for x in encoder.encode(part.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, decoded string of rows with doc_id and ids array<int>; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(path)
        for part in slices(batches, keep="trie"):
            texts = [None if x is None else encoder.decode(np.array([i for i in x if i is not None], np.int64)) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and hashes of the ids and of what the ids decode to, both taken in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(path)
        for part in slices(batches, keep="trie"):
            found = encoder.encode(part.column(1).to_pylist())
            columns = [
                part.column(0),
                pa.array([len(x) // 4 for x in found], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in found], pa.string()),
                pa.array([hashlib.sha256(encoder.decode(np.frombuffer(x, "<u4")).encode()).hexdigest() for x in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
