"""Which words may be the same word: misspelt, or written as another that sounds the same."""

from __future__ import annotations

import re
from functools import lru_cache

# English words that sound the same though the rules below do not tell.
HOMOPHONES = (
    "to too two", "for four fore", "no know", "one won", "eight ate", "our hour", "eye i aye", "you ewe yew", "new knew gnu", "by buy bye", "be bee", "in inn", "or oar ore", "so sew sow", "see sea", "are r",
    "the thee", "a uh", "there their theyre", "which witch", "would wood", "where wear ware", "whether weather", "while wile", "wait weight", "way weigh whey", "week weak", "write right rite wright", "night knight",
    "some sum", "son sun", "sale sail", "scene seen", "steal steel", "tail tale", "threw through", "tide tied", "toe tow", "waist waste", "pair pear pare", "peace piece", "plain plane", "principal principle",
    "rain reign rein", "road rode rowed", "role roll", "root route", "sight site cite", "stair stare", "hair hare", "hear here", "heal heel", "hole whole", "him hymn", "its its", "knot not", "lead led", "loan lone",
    "made maid", "mail male", "meat meet", "morning mourning", "none nun", "past passed", "blue blew", "brake break", "cell sell", "cent scent sent", "dear deer", "die dye", "fair fare", "flour flower", "great grate",
    "guessed guest", "allowed aloud", "ant aunt", "ball bawl", "bare bear", "bean been", "board bored", "ceiling sealing", "cereal serial", "coarse course", "flea flee", "hi high", "higher hire", "key quay", "mist missed",
    "pause paws", "poor pour pore", "sole soul", "sort sought", "than then", "whose whos", "your youre yore", "if iff", "bow bough", "mussel muscle", "berry bury", "bail bale", "beat beet", "mane main", "vain vein vane", "pail pale", "peak peek pique", "thrown throne", "tea tee", "wine whine", "waive wave", "veil vale", "wrap rap", "ring wring", "cord chord", "cash cache", "colonel kernel", "mantel mantle", "medal meddle metal mettle", "pedal peddle", "gilded guilded", "guild gild", "minor miner", "moat mote", "mourn morn", "naval navel", "sweet suite", "lynx links", "might mite", "moose mousse", "mustard mustered", "profit prophet", "rays raise raze", "review revue", "rose rows", "rung wrung", "sear seer", "shear sheer", "slay sleigh", "soar sore", "stake steak", "stationary stationery", "straight strait", "tacks tax", "tents tense", "tick tic", "tire tyre", "toad towed", "use ewes", "wail whale", "warn worn", "yolk yoke",
)
_GROUP: dict[str, set[int]] = {}
for _i, _line in enumerate(HOMOPHONES):
    for _w in _line.split():
        _GROUP.setdefault(_w, set()).add(_i)
# Spelling to sound, in order.
_SOUND = [(re.compile(a), b) for a, b in (("^kn", "n"), ("^gn", "n"), ("^wr", "r"), ("^ps", "s"), ("^wh", "w"), ("^x", "s"), ("mb$", "m"), ("tch", "C"), ("sch", "sk"), ("ch", "C"), ("sh", "S"), ("[st]ion", "Sn"), ("ph", "f"), ("ight", "ite"), ("ough", "o"), ("augh", "a"), ("gh", "g"), ("th", "T"), ("dge", "j"), ("ck", "k"), ("qu", "kw"), ("q", "k"), ("c(?=[eiy])", "s"), ("c", "k"), ("g(?=[eiy])", "j"), ("z", "s"), ("x", "ks"), ("v", "f"), ("(?<=[aeiou])[wyh]", ""), ("h$", ""))]


@lru_cache(maxsize=200_000)
def sound(word: str) -> str:
    """A coarse sound key: consonant sounds, doubles once, vowels only as a mark at the start."""
    s = word
    for pattern, to in _SOUND:
        s = pattern.sub(to, s)
    s = re.sub(r"(.)\1+", r"\1", s)
    return ("A" if s[:1] in "aeiouy" else s[:1]) + re.sub("[aeiouyh]", "", s[1:])


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours; most + 1 if it is more than ``most``. Only a band of the table is filled, so long words cost their length."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    before: dict[int, int] = {}
    last = {j: j for j in range(min(most, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        row = {0: i} if i <= most else {}
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            y = b[j - 1]
            v = min(last.get(j, far) + 1, row.get(j - 1, far) + 1, last.get(j - 1, far) + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before.get(j - 2, far) + 1)
            row[j] = v
        if min(row.values(), default=far) > most:
            return far
        before, last = last, row
    return min(far, last.get(len(b), far))


NEAR = 3  #: characters by which two spellings of a word may differ in length


def allowed(a: str, b: str) -> int:
    """Edits that may lie between two spellings of one word."""
    n = max(len(a), len(b))
    return 0 if n < 4 or a.isdigit() or b.isdigit() else 1 if n < 8 else 2


def same_word(a: str, b: str) -> bool:
    if a == b:
        return True
    if _GROUP.get(a, frozenset()) & _GROUP.get(b, frozenset()):
        return True
    k = allowed(a, b)
    if k and edits(a, b, k) <= k:
        return True
    s = sound(a)
    return len(s) > 2 and s == sound(b) and abs(len(a) - len(b)) <= NEAR and not (a.isdigit() or b.isdigit())


def deletions(word: str, k: int) -> set[str]:
    out, level = {word}, {word}
    for _ in range(k):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out |= level
    return out


LONG = 32  #: characters; longer words meet by their length, since they have very many deletions and there are few of them


class Lexicon:
    """Finds all words of a fixed list that a given word may be. Words meet in the deletions they share, in their sound or in a homophone
    group; words about as long as LONG or longer meet all listed words of nearly their length."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        self.by: dict[str, list[int]] = {}
        self.by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) <= LONG:
                for key in self._keys(w):
                    self.by.setdefault(key, []).append(i)
            if len(w) > LONG - NEAR:
                self.by_length.setdefault(len(w), []).append(i)
        self.cache: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def _keys(w: str) -> set[str]:
        return deletions(w, 0 if len(w) < 3 else 1 if len(w) < 7 else 2) | {"~" + sound(w)} | {f"={g}" for g in _GROUP.get(w, ())}

    def matches(self, word: str) -> tuple[int, ...]:
        got = self.cache.get(word)
        if got is None:
            near = {i for n in range(len(word) - NEAR, len(word) + NEAR + 1) for i in self.by_length.get(n, ())} if len(word) > LONG - NEAR else set()
            if len(word) <= LONG:
                near.update(i for key in self._keys(word) for i in self.by.get(key, ()))
            got = tuple(sorted(i for i in near if same_word(word, self.words[i])))
            if len(self.cache) > 300_000:
                self.cache.clear()
            self.cache[word] = got
        return got
