"""Free-entered names against a closed list: trie of the list, searched with a Levenshtein automaton."""

from __future__ import annotations

import html
import re
import unicodedata

#: Texts that stand for "no value".
BLANK_WORDS = {"", "na", "nan", "none", "unclassified"}
#: Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсухіјѕкмтнвзԁԛԝαοεικνρτυχβηκμγ", "aeopcyxijskmthbzdqwaoeiknptuxbnkmy")
#: Digits that are read for letters.
DIGIT_LETTERS = str.maketrans("015", "ols")
#: Open-nomenclature marks and life stages; never part of a name.
MARKS = {"sp", "spp", "cf", "aff", "nr", "larva", "larvae", "juv", "juvenile", "adult", "egg", "eggs", "indet", "gen", "nov", "voucher", "taxon", "species", "fish", "id"}

_ENTITY = re.compile(r"&#?\w+;?")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z][a-z]+$)")
_TOKEN = re.compile(r"[^\W_]+")
_BRACKETED = re.compile(r"\([^()]*\)")


def is_blank(raw: str | None) -> bool:
    return raw is None or raw.strip().lower() in BLANK_WORDS


def tidy(raw: str | None) -> str:
    """One plain spelling: compatibility forms, entities, look-alike letters and separators folded; case kept."""
    if raw is None:
        return ""
    s = raw
    for _ in range(2):
        s = _ENTITY.sub(lambda m: html.unescape(m[0]), s)
    s = s.replace("%20", " ").replace("_", " ").replace("+", " ")
    s = unicodedata.normalize("NFKC", s)
    s = "".join(c for c in s if unicodedata.category(c) != "Cf")
    s = "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")
    low = s.lower().translate(LOOKALIKES)
    if len(low) == len(s):
        s = "".join(a if a.lower() == b else (b.upper() if a.isupper() else b) for a, b in zip(s, low))
    return " ".join(s.split())


def tokens(raw: str | None) -> list[str]:
    """Lower-case words of a name; digits inside a word become letters, authorship in brackets goes."""
    out = []
    for t in _TOKEN.findall(_BRACKETED.sub(lambda m: m[0] if re.search(r"[a-z]{4}", m[0]) and not re.search(r"\d{4}", m[0]) else " ", tidy(raw))):
        low = t.lower()
        if re.search(r"\d", low) and re.search(r"[a-z]{3}", low):
            low = low.translate(DIGIT_LETTERS)
        out.append(low)
    return out


def limit(n: int) -> int:
    """Edits allowed for a name of n letters."""
    return 0 if n < 5 else 1 if n < 8 else 2 if n < 13 else 3 if n < 20 else 4


#: Share of the listed epithets that must end in the same two letters for these to tell an epithet from an ordinary word.
ENDING_SHARE = 0.005
#: Endings of Latin epithets, whatever the list.
LATIN = ("us", "um", "is", "ii", "ae", "a")


class Trie:
    """Nodes are dicts from letter to node; the key "" holds the entries that end there."""

    def __init__(self) -> None:
        self.root: dict = {}
        self.exact: dict[str, list[str]] = {}
        self.shortest, self.longest = 1 << 30, 0

    def add(self, word: str, entry: str) -> None:
        node = self.root
        self.shortest, self.longest = min(self.shortest, len(word)), max(self.longest, len(word))
        for c in word:
            node = node.setdefault(c, {})
        node.setdefault("", []).append(entry)
        self.exact.setdefault(word, []).append(entry)

    def below(self, prefix: str) -> dict | None:
        """The node at the end of a prefix."""
        node = self.root
        for c in prefix:
            node = node.get(c)
            if node is None:
                return None
        return node

    def within(self, q: str, k: int, root: dict | None = None) -> dict[str, int]:
        """Entries within k edits of q with their distance; below `root`, if given, of what follows there.

        An edit is a letter added, lost or replaced, two neighbours exchanged, or rn read as m and the
        reverse. The automaton's state is a row of distances in a band of k round the diagonal; a branch
        is left when the row and the one before hold nothing within k.
        """
        n, far, found = len(q), k + 1, {}
        if root is None and (n < self.shortest - k or n > self.longest + k):
            return found
        # a row holds the cells of columns depth - k to depth + k; column j lies at j - depth + k
        width = 2 * k + 1
        first = [far] * k + [j if j <= n else far for j in range(k + 1)]
        stack = [(self.root if root is None else root, first, None, "", 0)]
        push, pop = stack.append, stack.pop
        while stack:
            node, row, before, letter, depth = pop()
            end = n - depth + k
            if "" in node and 0 <= end < width and row[end] <= k:
                d = row[end]
                for e in node[""]:
                    if d < found.get(e, far):
                        found[e] = d
            i = depth + 1
            if i - k > n:
                continue
            lo, hi = max(0, k - i), min(width - 1, n - i + k)
            alive = min(row) < k
            for c, child in node.items():
                if c == "":
                    continue
                new = [far] * width
                best = far
                for o in range(lo, hi + 1):
                    j = i + o - k
                    if j == 0:
                        d = i
                    else:
                        qc = q[j - 1]
                        d = row[o]
                        if qc != c:
                            if o + 1 < width and row[o + 1] < d:
                                d = row[o + 1]
                            if o and new[o - 1] < d:
                                d = new[o - 1]
                            d += 1
                            if qc == letter and before is not None and j > 1 and q[j - 2] == c and before[o] + 1 < d:
                                d = before[o] + 1
                            if c == "m" and qc == "n" and o and j > 1 and q[j - 2] == "r" and row[o - 1] + 1 < d:
                                d = row[o - 1] + 1
                            if qc == "m" and c == "n" and letter == "r" and before is not None and o + 1 < width and before[o + 1] + 1 < d:
                                d = before[o + 1] + 1
                    if d < far:
                        new[o] = d
                        if d < best:
                            best = d
                if best <= k or alive:
                    push((child, new, row, c, i))
        return found


class Resolver:
    """Species list with its alias paths.

    The trie holds each species as genus and epithet joined, so that a lost or added space costs nothing, and the
    alias paths "initial + epithet". Two entries that a spelling is equally close to are no match.
    """

    def __init__(self, entries: list[tuple[str, str, str | None, str | None]]) -> None:
        """entries: (label, species_name, genus_name, genus_from_label)."""
        self.full, self.genera, self.short = Trie(), Trie(), {}
        self.genus_of, self.memo, self.genus_memo, self.shorts = {}, {}, {}, Trie()
        ends: dict[str, int] = {}
        for label, species, genus, label_genus in sorted(entries, key=lambda e: e[0] or ""):
            words = (species or "").lower().split()
            if not label or len(words) < 2:
                continue
            self.full.add("".join(words), label)
            self.genus_of[label] = species.split()[0]
            ends[words[1][-2:]] = ends.get(words[1][-2:], 0) + 1
            self.short.setdefault((words[0][0], words[1]), []).append(label)
        self.endings = {e for e, n in ends.items() if n >= ENDING_SHARE * sum(ends.values())}
        known: dict[str, str] = {}
        for g in sorted({x for e in entries for x in (e[1].split()[0] if e[1] else None, e[2], e[3]) if not is_blank(x)}):
            known.setdefault(g.lower(), g)
        for low, g in known.items():
            self.genera.add(low, g)
        for (initial, epithet), labels in self.short.items():
            for label in labels:
                self.shorts.add(initial + epithet, label)

    def epithet(self, word: str) -> bool:
        """Whether a word ends as an epithet does."""
        return word[-2:] in self.endings or word.endswith(LATIN)

    # -- species -------------------------------------------------------------------------------

    def species(self, raw: str | None) -> str | None:
        """Label of the listed species that the text means, or None."""
        if is_blank(raw):
            return None
        if raw not in self.memo:
            if len(self.memo) > 500_000:
                self.memo.clear()
            self.memo[raw] = self._species(raw)
        return self.memo[raw]

    def _windows(self, words: list[str]) -> list[str]:
        seen = {}
        for i in range(len(words)):
            for j in (i + 2, i + 1, i + 3):
                if j <= len(words):
                    w = "".join(words[i:j])
                    if 8 <= len(w) <= 60 and not any(x in MARKS for x in words[i:j]):
                        seen.setdefault(w)
        return list(seen)

    def _species(self, raw: str) -> str | None:
        words = tokens(raw)
        if not words:
            return None
        wins = self._windows(words)
        if "," in raw and len(words) == 2:
            wins.append(words[1] + words[0])
        for w in wins:
            if w in self.full.exact:
                return self._only({e: 0 for e in self.full.exact[w]})
        for i, w in enumerate(words[:-1]):
            if len(w) == 1 and len(words[i + 1]) > 2:
                hits = self.short.get((w, words[i + 1]), [])
                if hits:
                    return hits[0] if len(hits) == 1 else None
                near = self.shorts.within(w + words[i + 1], min(2, limit(len(words[i + 1]))))
                return self._only({e: d for e, d in near.items() if self.genus_of[e][0].lower() == w})
        # a genus written right: only its species are asked
        for i, w in enumerate(words[:-1]):
            if w in self.genera.exact and (node := self.full.below(w)) is not None:
                near = {}
                for j in (i + 2, i + 3):
                    rest = "".join(words[i + 1 : j])
                    if len(rest) > 2 and not any(x in MARKS for x in words[i + 1 : j]):
                        for e, d in self.full.within(rest, min(limit(len(w + rest)), max(2, len(rest) // 3)), node).items():
                            near[e] = min(d, near.get(e, 99))
                return self._only(near)
        for k in (1, 2, 3, 4):
            near: dict[str, int] = {}
            for w in wins:
                if k <= limit(len(w)):
                    for e, d in self.full.within(w, k).items():
                        near[e] = min(d, near.get(e, 99))
            if near:
                return self._only(near)
        return None

    @staticmethod
    def _only(near: dict[str, int]) -> str | None:
        if not near:
            return None
        least = min(near.values())
        best = [e for e, d in near.items() if d == least]
        return best[0] if len(best) == 1 else None

    def label_for(self, species: str | None, label: str | None) -> str | None:
        """The entry named by the first text, else by the second."""
        return self.species(species) or self.species(label)


_JOINED = re.compile(r"^[A-Z][a-z]+(?=[A-Z][a-z]+$)")


class GenusReader:
    """Genus that a text names: of a listed species, of a listed genus, or an unlisted one written as a name."""

    def __init__(self, resolver: Resolver) -> None:
        self.of = resolver
        self.memo: dict[str, str | None] = {}

    def listed(self, word: str) -> str | None:
        """Listed genus closest to a word, None where there is none or no single one."""
        known = self.of.genera.exact.get(word)
        if known:
            return known[0]
        if word not in self.memo:
            if len(self.memo) > 500_000:
                self.memo.clear()
            hit = None
            for k in range(1, min(2, limit(len(word))) + 1):
                near = self.of.genera.within(word, k)
                if near:
                    hit = Resolver._only(near)
                    break
            self.memo[word] = hit
        return self.memo[word]

    def named(self, raw: str | None) -> tuple[str | None, bool]:
        """(genus of a species name or label, whether the text alone tells it).

        An unlisted genus is told by a second word that ends as epithets of the list do; other pairs of words name one only if it is met
        elsewhere too.
        """
        if is_blank(raw):
            return None, False
        label = self.of.species(raw)
        if label:
            return self.of.genus_of[label], True
        joined = _JOINED.match(tidy(raw))
        words = [joined[0].lower()] if joined else []
        words += [w for w in tokens(raw) if w not in MARKS and not w.isdigit()]
        if "," in raw and len(words) == 2:
            words.reverse()
        if not words or len(words[0]) < 4:
            return None, False
        hit = self.listed(words[0])
        if hit:
            return hit, True
        if (len(words) > 1 or joined) and words[0].isalpha():
            return words[0].capitalize(), self.of.epithet(words[1])
        return None, False

    def from_name(self, raw: str | None) -> str | None:
        """Genus of a species name or label, where the text alone tells it."""
        genus, sure = self.named(raw)
        return genus if sure else None

    def from_name_if_met(self, raw: str | None) -> str | None:
        """Genus that a text may name, if it is met elsewhere."""
        genus, sure = self.named(raw)
        return None if sure else genus

    def from_genus(self, raw: str | None) -> str | None:
        """Genus of a genus field."""
        if is_blank(raw):
            return None
        words = [w for w in tokens(raw) if w not in MARKS and not w.isdigit()]
        if not words:
            return None
        hit = self.listed(words[0])
        alone = len(words) == 1 or self.of.epithet(words[1])
        return hit or (words[0].capitalize() if alone and words[0].isalpha() and len(words[0]) > 3 else None)
