"""Byte-level BPE by depth-first traversal of the trie of distinct words."""

from __future__ import annotations

import base64

import regex

#: Fixed value: how a text is cut into words before the merges (the pattern of the public vocabulary).
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def load_ranks(path: str = DEFAULT_VOCABULARY) -> dict[bytes, int]:
    """Token bytes to id (which is also the merge rank) of a vocabulary file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteBpe:
    """Encoder whose state is the last token of every prefix.

    The encoding of a prefix is the encoding of a shorter prefix and one more token; a token may follow another if the two,
    merged from their bytes, come out as themselves. So each trie node needs one lookup of its last token,
    and words that share a prefix share its nodes. Sorted words are visited in the trie's depth-first order.
    """

    def __init__(self, ranks: dict[bytes, int], words: str = WORDS, keep: int = 300_000) -> None:
        self.ranks, self.cutter, self.keep = ranks, regex.compile(words), keep
        self.text = {i: b for b, i in ranks.items()}
        self.memo: dict[str, tuple[int, ...]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.suffixes: dict = {}
        for token, i in ranks.items():
            node = self.suffixes
            for byte in reversed(token):
                node = node.setdefault(byte, {})
            node[-1] = i
        self.whole: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """Plain BPE: the neighbours of lowest rank are merged until none can be."""
        parts = [bytes([b]) for b in data]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def follows(self, a: int, b: int) -> bool:
        key = (a, b)
        hit = self.fits.get(key)
        if hit is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            hit = self.fits[key] = self.merged(self.text[a] + self.text[b]) == [a, b]
        return hit

    def stands(self, t: int) -> bool:
        hit = self.whole.get(t)
        if hit is None:
            hit = self.whole[t] = self.merged(self.text[t]) == [t]
        return hit

    def encode_words(self, words: list[str]) -> None:
        """Fill the memo with all words, in the order of the trie."""
        raw = sorted((w.encode("utf-8"), w) for w in words)
        last: list[int] = [-1]  # last[i]: last token of the first i bytes
        path = b""
        for data, word in raw:
            same, most = 0, min(len(path), len(data))
            while same < most and path[same] == data[same]:
                same += 1
            del last[same + 1 :]
            for i in range(same + 1, len(data) + 1):
                node, j, found = self.suffixes, i, []
                while j > 0:
                    node = node.get(data[j - 1])
                    if node is None:
                        break
                    j -= 1
                    t = node.get(-1)
                    if t is not None:
                        found.append((j, t))
                for j, t in reversed(found):
                    if self.stands(t) if j == 0 else self.follows(last[j], t):
                        last.append(t)
                        break
            path, ids, i = data, [], len(data)
            while i > 0:
                ids.append(last[i])
                i -= len(self.text[last[i]])
            self.memo[word] = tuple(reversed(ids))

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; null and empty texts have none."""
        cut = [self.cutter.findall(t) if t else [] for t in texts]
        new = {w for ws in cut for w in ws if w not in self.memo}
        if len(self.memo) + len(new) > self.keep:
            self.memo.clear()
            new = {w for ws in cut for w in ws}
        if new:
            self.encode_words(list(new))
        out = []
        for ws in cut:
            ids: list[int] = []
            for w in ws:
                ids += self.memo[w]
            out.append(ids)
        return out
