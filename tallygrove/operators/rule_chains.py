"""Ignore rules compiled once for every chain of directories that have some.

All directories below the same nearest one with rules of its own share a chain: its rules and those
of the directories above, strongest first. Every rule has a handle, a text that a path or its name
must be, start with or end with to match, and is looked up by its hash. Where the handle does not say
all, rules of one handle are one regex, whose first alternative that matches is the strongest. So a
path costs a few lookups, however many rules there are.
"""

import re
from functools import lru_cache

ALWAYS = 2  # from this level on, rules hold outside repositories, too
MEMO = 100_000  # directories judged before, of a task

_RULE = re.compile(r"\(\?s\)\\A(\(\?:\.\*/\)\?)?\(\?:(.*)\)\\z", re.DOTALL)
_LITERAL = r"(?:[A-Za-z0-9_/]|[^\x00-\x7f]|\\[^A-Za-z0-9])"
_BEGINNING = re.compile(rf"{_LITERAL}*")
_TOKEN = re.compile(r"\\.|.", re.DOTALL)
_IS_LITERAL = re.compile(_LITERAL, re.DOTALL).fullmatch
_ANY = "[^/]*"

# Kinds of handles: what the text is of the name, or of the path below the rule's directory.
NAME, PATH, NAME_STARTS, NAME_ENDS, PATH_STARTS, PATH_ENDS = range(6)


def _plain(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def _ending(body: str) -> str:
    """The longest literal that a regex ends with, as it stands there."""
    tokens = _TOKEN.findall(body)
    at = len(tokens)
    while at and _IS_LITERAL(tokens[at - 1]):
        at -= 1
    return "".join(tokens[at:])


@lru_cache(MEMO)
def handle(rx: str) -> tuple[int, str, bool]:
    """(kind, text, whole) of a rule; every path it matches has the text, with `whole` just these."""
    anywhere, body = _RULE.fullmatch(rx).groups()
    inner = "/" not in body.replace("[^/]", "").replace("(?!/)", "") and ".*" not in body
    starts, ends = _BEGINNING.match(body)[0], _ending(body)
    if starts == body and (inner or not anywhere):
        return NAME if anywhere else PATH, _plain(body), True
    if not anywhere:
        return (PATH_STARTS, _plain(starts), False) if len(starts) > len(ends) else (PATH_ENDS, _plain(ends), False)
    if not inner:
        return PATH_ENDS, _plain(ends), False
    if len(starts) > len(ends):
        return NAME_STARTS, _plain(starts), body == starts + _ANY
    return NAME_ENDS, _plain(ends), body == _ANY + ends


class Chain:
    """Rules as (base key, neg, dironly, regex), strongest first."""

    def __init__(self, rules: list):
        self.neg = [neg for _, neg, _, _ in rules]
        self.rules, self.tables = rules, {}

    def _tables(self, is_dir):
        """Names, paths, and (of the name, at its start, sizes, texts) for each other kind."""
        names, paths, parts = {}, {}, {}
        for number, (base, _, dironly, rx) in enumerate(self.rules):
            if dironly and not is_dir:
                continue
            kind, text, whole = handle(rx)
            if kind == NAME:
                # A name from a base deeper than the path never meets it: chains are of its own directory.
                names.setdefault(text, number)
            elif kind == PATH:
                paths.setdefault(f"{base}/{text}", number)
            else:
                text = f"{base}/{text}" if kind == PATH_STARTS else text
                found = parts.setdefault(kind, {}).setdefault(text, [len(self.neg), []])
                if whole:
                    found[0] = min(found[0], number)
                else:
                    found[1].append(number)
        looks = []
        for kind, texts in parts.items():
            compiled = {text: (best, self._regex(rest), rest) for text, (best, rest) in texts.items()}
            of_name, at_start = kind in (NAME_STARTS, NAME_ENDS), kind in (NAME_STARTS, PATH_STARTS)
            looks.append((of_name, at_start, sorted({len(x) for x in texts}), compiled))
        return names, paths, looks

    def _regex(self, numbers):
        bodies = []
        for base, _, _, rx in (self.rules[number] for number in numbers):
            anywhere, body = _RULE.fullmatch(rx).groups()
            bodies.append(f"({re.escape(base)}/{anywhere or ''}(?:{body}))")
        return re.compile(r"(?s)\A(?:%s)\Z" % "|".join(bodies)) if bodies else None

    def ignores(self, key: str, is_dir: bool) -> bool:
        """Does the strongest rule that matches say ignore?"""
        if is_dir not in self.tables:
            self.tables[is_dir] = self._tables(is_dir)
        names, paths, looks = self.tables[is_dir]
        name = key[key.rindex("/") + 1 :]
        none = len(self.neg)
        best = min(names.get(name, none), paths.get(key, none))
        for of_name, at_start, sizes, texts in looks:
            subject = name if of_name else key
            for size in sizes:
                if size > len(subject):
                    break
                found = texts.get(subject[:size] if at_start else subject[len(subject) - size :])
                if found:
                    number, regex, numbers = found
                    best = min(best, number)
                    if regex and numbers[0] < best and (match := regex.match(key)):
                        best = min(best, numbers[match.lastindex - 1])
        return best < none and not self.neg[best]


class Chains:
    """Judges the keys of files and directories.

    `rules` are (base key, level, line, neg, dironly, regex). With `tops`, keys of repositories,
    rules of the git kinds hold only inside one, those from above the innermost not. `top` is the
    key up to which nothing is judged.
    """

    def __init__(self, rules: list, tops: list | None, top: str = ""):
        self.own = {}
        for base, level, line, neg, dironly, rx in rules:
            self.own.setdefault(base, []).append((level, len(base), line, neg, dironly, rx, base))
        self.tops, self.top = None if tops is None else set(tops), top
        self.speaking = set(self.own) | (self.tops or set())
        self.chains, self.judged = {}, {}

    def _above(self, key):
        """The key and those above it, the nearest first."""
        while key:
            yield key
            key = key[: key.rindex("/")]
        yield ""

    def chain(self, directory: str) -> Chain:
        nearest = next((k for k in self._above(directory) if k in self.speaking), "")
        if nearest not in self.chains:
            way = list(self._above(nearest))
            least = 0 if self.tops is None else next((len(k) for k in way if k in self.tops), None)
            rules = [r for k in way for r in self.own.get(k, ()) if r[0] >= ALWAYS or (least is not None and r[1] >= least)]
            rules.sort(reverse=True)
            self.chains[nearest] = Chain([(base, neg, dironly, rx) for _, _, _, neg, dironly, rx, base in rules])
        return self.chains[nearest]

    def hidden(self, directory: str) -> bool:
        """Is the directory, or one above it, ignored?"""
        if len(directory) <= len(self.top):
            return False
        known = self.judged.get(directory)
        if known is None:
            if len(self.judged) >= MEMO:
                self.judged.clear()
            parent = directory[: directory.rindex("/")]
            known = self.hidden(parent) or self.chain(parent).ignores(directory, True)
            self.judged[directory] = known
        return known

    def gone(self, key: str) -> bool:
        """Is the file hidden, by its own rule or by a directory above it?"""
        parent = key[: key.rindex("/")]
        return self.hidden(parent) or self.chain(parent).ignores(key, False)
