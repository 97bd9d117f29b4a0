"""Names and literals of source and configuration text, in one pass.

The lexer never goes back: each token is read once, so the time grows with the
length of the text. What it pairs:

* ``name = x``, ``name: x``, ``name := x``, ``name => x``, quoted and subscripted names,
  ``--name x``; types between name and ``=`` (``name: T = x``, ``name T = x``);
* members of braces, brackets and calls with the names they stand under
  (``keys = ["x"]``, ``set_key("x")``, ``put("NAME", "x")``), lines indented under
  ``name:``, and ``name="NAME" value="x"``;
* quoted texts (with escapes), triple-quoted ones, back quotes over lines,
  ``name: |`` blocks and ``<<EOT`` texts, line by line; what stands within a quoted text or
  behind a comment mark is read as source too;
* ``+``, ``.`` and ``..`` between texts, over line breaks for ``+``, texts side by side, and
  ``${name}`` within one.

Constants are links to earlier values of the same scope (braces, or an indented
``def`` or ``class``), so that values built of many others cost no more than they
are long. Members of a named brace are known as ``name.member`` behind it.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable

_QUOTED = r"""(?<![A-Za-z0-9_])(?:"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`)(?![A-Za-z0-9_])"""
_TRIPLE = r'''"""(?:[^"\\]|\\.|"(?!""))*+"""|\'\'\'(?:[^'\\]|\\.|'(?!''))*+\'\'\''''
_MAIN = re.compile(
    rf"""(?P<triple>{_TRIPLE})|(?P<quoted>{_QUOTED})|(?P<prefix>[rRbBfFuU]{{1,2}}(?=["']))|(?P<name>[A-Za-z_][A-Za-z0-9_.-]*+)
    |(?P<line>\r?\n)|(?P<open>[\[({{])|(?P<close>[\])}}])|(?P<op>:=|=>|=(?!=)|:(?![:/]))|(?P<pass>::|==+|[!<>]=|->|://?)
    |(?P<angle>[<>])|(?P<end>[,;])|(?P<dash>--?)|(?P<space>[ \t]+)|(?P<rest>[^\n"'`A-Za-z_\[\](){{}}:=,;<>\x20\t\r-]+|.)""",
    re.VERBOSE | re.DOTALL,
)
_BARE = re.compile(r"[A-Za-z0-9_][A-Za-z0-9_.+/=-]*+")
_TERM = re.compile(rf"[rRbBfFuU]{{0,2}}(?:(?P<triple>{_TRIPLE})|(?P<quoted>(?:(?<=[rRbBfFuU])|(?<![A-Za-z0-9_])){_QUOTED.split(')', 1)[1]}))|(?P<many>`[^`]*+`)", re.DOTALL)
_SPACE = re.compile(r"[ \t]*+")
_JOIN = re.compile(r"[ \t]*+(?:\+|\.\.|\.(?=[ \t]))[ \t]*+")
_JOIN_LINES = re.compile(r"(?:[ \t]|\\?\r?\n)*+\+(?:[ \t]|\\?\r?\n)*+")
_ANOTHER = re.compile(r"""[ \t]*+["'`]?\]?[ \t]*+[?!]?[ \t]*+[:=]""")
_IDENTIFIER = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)*\Z")
_BLOCK = re.compile(r"[ \t]*[|>][+-]?[0-9]?[+-]?[ \t]*(?:#[^\n]*)?\r?\n")
_HERE = re.compile(r"<<[-~]?[ \t]*([\"']?)([A-Za-z_][A-Za-z0-9_]*)\1[^\n]*\n")
_OPENING = re.compile(r"^[ \t]*([A-Za-z_][A-Za-z0-9_]*)", re.MULTILINE)
_LINE = re.compile(r"[^\s][^\n]*")
#: What stands before the secret in a header.
_SCHEME = re.compile(r"(?:Bearer|Basic|Token)[ \t]+(?=[A-Za-z0-9])")
_SLOT = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_.]*)\}")
_SCOPE = re.compile(r"(?:async[ \t]+)?(?:def|class)[ \t]")
#: Words that introduce a declaration and name nothing.
_WORDS = {"var", "const", "let", "static", "final", "export", "public", "private", "protected", "readonly", "mut", "auto", "def", "local", "val", "set"}
_LABELS, _VALUES = {"name", "key", "id", "variable"}, {"value", "val", "content", "default"}


#: Characters of a name that count, its last ones.
NAME = 200


class Level:
    """An open bracket, or the text itself. ``names`` is what it stands under."""

    def __init__(self, kind: str, names: tuple[str, ...] = (), direct: bool = False):
        self.kind, self.names, self.direct = kind, names, direct
        self.begin()
        self.label: str | None = None
        self.first: str | None = None
        self.mark: int | None = None
        self.members: list[tuple[str, int]] = []

    def begin(self) -> None:
        """A new statement."""
        self.recent: list[tuple[str, str, int]] = []  # names and quoted texts since its start
        self.typed: str | None = None  # the name before a colon
        self.pending: tuple[str, ...] = ()  # the names of its value, for texts that follow
        self.angle = 0
        self.query = False  # whether the last name stands in the query of an address


class Lexer:
    """``found(names, inherited, parts)`` is called for each value: its names, the
    names around it, and its node. A node is a literal or a list of nodes."""

    def __init__(self, text: str, found: Callable[[tuple[str, ...], tuple[str, ...], int], None]):
        self.text, self.found = text, found
        self.literals: list[tuple[int, int] | None] = []  # (start, end) of a literal node
        self.parts: list[tuple[int, ...]] = []  # nodes that a node is joined of
        self.known: dict[str, int] = {}
        self.undo: list[tuple[str, int | None]] = []
        self.within = 0  # where a block of lines ends; blocks hold no blocks
        self.openings: dict[str, list[int]] | None = None  # lines by the word they open with
        self.inner: list[tuple[int, int]] = []
        self.run(0, len(text))
        todo, self.inner = self.inner, []
        for start, end in todo:  # texts within texts, once
            self.within = 0
            self.run(start, end)

    # -- nodes -----------------------------------------------------------------

    def literal(self, start: int, end: int) -> int:
        self.literals.append((start, end))
        self.parts.append(())
        return len(self.parts) - 1

    def joined(self, nodes: list[int]) -> int:
        if len(nodes) == 1:
            return nodes[0]
        self.literals.append(None)
        self.parts.append(tuple(nodes))
        return len(self.parts) - 1

    def quoted(self, start: int, end: int) -> list[int]:
        """The nodes of a quoted text's inside; ``${name}`` is put in if all such names are known."""
        slots = list(_SLOT.finditer(self.text, start, end))
        if slots and all(s[1] in self.known for s in slots):
            out, at = [], start
            for s in slots:
                out += [self.literal(at, s.start())] if s.start() > at else []
                out.append(self.known[s[1]])
                at = s.end()
            return out + ([self.literal(at, end)] if end > at else [])
        if scheme := _SCHEME.match(self.text, start, end):
            start = scheme.end()
        return [self.literal(start, end)] if end > start else []

    # -- scopes ----------------------------------------------------------------

    def learn(self, name: str, node: int) -> None:
        self.undo.append((name, self.known.get(name)))
        self.known[name] = node

    def back(self, mark: int) -> None:
        while len(self.undo) > mark:
            name, old = self.undo.pop()
            if old is None:
                del self.known[name]
            else:
                self.known[name] = old

    # -- values ----------------------------------------------------------------

    def lines(self, start: int, end: int) -> list[int]:
        """A literal for each line that holds something."""
        out = []
        for m in _LINE.finditer(self.text, start, end):
            stop = m.start() + len(m[0].rstrip())
            out.append(self.literal(m.start(), stop))
        return out

    def block(self, at: int, end: int) -> tuple[list[int], int] | None:
        """The lines under ``name: |``, which are indented more than the line of the name."""
        m = _BLOCK.match(self.text, at, end)
        if not m or at < self.within:
            return None
        line = self.text.rfind("\n", 0, at) + 1
        indent = len(self.text[line:at]) - len(self.text[line:at].lstrip(" -"))
        stop = m.end()
        while stop < end:
            next_line = self.text.find("\n", stop, end)
            next_line = end if next_line < 0 else next_line + 1
            body = _SPACE.match(self.text, stop, end).end()
            if body - stop <= indent and self.text[body : body + 1] not in ("\n", "\r", ""):
                break
            stop = next_line
        self.within = stop
        return self.lines(m.end(), stop), m.end()

    def here(self, at: int, end: int) -> tuple[list[int], int] | None:
        m = _HERE.match(self.text, at, end)
        if not m or at < self.within:
            return None
        if self.openings is None:
            self.openings = {}
            for word in _OPENING.finditer(self.text):
                self.openings.setdefault(word[1], []).append(word.start())
        places = self.openings.get(m[2], [])
        i = bisect_left(places, m.end())
        if i == len(places) or places[i] > end:
            return None
        self.within = places[i]
        return self.lines(m.end(), places[i]), m.end()

    def term(self, at: int, end: int) -> tuple[list[int], int, bool] | None:
        """A quoted text at a place: nodes, where it ends, and whether it has lines."""
        m = _TERM.match(self.text, at, end)
        if not m:
            return None
        width = 3 if m["triple"] else 1
        start, stop = m.end() - len(m[m.lastgroup]) + width, m.end() - width
        if any(c in self.text[start:stop] for c in "=:"):
            self.inner.append((start, stop))
        if "\n" in self.text[start:stop]:
            return self.lines(start, stop), m.end(), True
        return self.quoted(start, stop), m.end(), False

    def value(self, at: int, end: int, op: str, typed: bool, tight: bool) -> tuple[list[int], list[int], int]:
        """What stands at a place: nodes that make one value, or nodes of lines, and where it ends."""
        for special in (self.block, self.here) if op == ":" or self.text.startswith("<<", at) else ():
            if got := special(at, end):
                return [], got[0], got[1]
        nodes: list[int] = []
        if scheme := _SCHEME.match(self.text, at, end):
            at = scheme.end()
        first, stop = True, at
        while True:
            m = self.term(at, end)
            if m and m[2]:
                return [], m[0], m[1]
            if m:
                nodes += m[0]
                stop = m[1]
                after = _SPACE.match(self.text, stop, end).end()
                if self.text[after : after + 1] in "\"'" and after < end and _TERM.match(self.text, after, end) and not _ANOTHER.match(self.text, _TERM.match(self.text, after, end).end(), end):
                    at, first = after, False
                    continue
            else:
                bare = _BARE.match(self.text, at, end)
                if not bare:
                    break
                word, stop = bare[0], bare.end()
                while word.endswith(("+", "=")) and word.rstrip("+=") in self.known:  # name+"x"
                    stop -= 1
                    word = word[:-1]
                if word in self.known:
                    nodes.append(self.known[word])
                elif first and not typed and self.plain(word, stop, end, op, tight):
                    nodes.append(self.literal(at, stop))
                elif not _IDENTIFIER.match(word):
                    break
            join = _JOIN.match(self.text, stop, end)
            if not join:
                join = _JOIN_LINES.match(self.text, stop, end)
                follows = join and self.next_term(join.end(), end)
                # a text on another line may be the name of a next pair
                if not follows or not any(c in self.text[stop : join.end()] for c in "\n") or _ANOTHER.match(self.text, follows, end) or not (m or any(c in "\"'`" for c in self.text[join.end() : join.end() + 2])):
                    break
            at, first = join.end(), False
            if not self.next_term(at, end):
                more = _JOIN_LINES.match(self.text, stop, end)
                follows = more and self.next_term(more.end(), end)
                if not follows or _ANOTHER.match(self.text, follows, end):
                    break
                at = more.end()
        return nodes, [], stop

    def next_term(self, at: int, end: int) -> int | None:
        m = _TERM.match(self.text, at, end) or _BARE.match(self.text, at, end)
        return m.end() if m else None

    def plain(self, word: str, stop: int, end: int, op: str, tight: bool) -> bool:
        """Whether a bare word is a literal, as in ini files, and no name."""
        if self.text[stop : stop + 1] == "(":
            return False
        if not _IDENTIFIER.match(word):
            return True
        join = _JOIN_LINES.match(self.text, stop, end)
        if join and self.next_term(join.end(), end) and "\n" not in self.text[stop : join.end()]:
            return False
        closed = stop >= end or self.text[stop] in " \t\r\n;"
        return any(c.isdigit() for c in word) and "." not in word or tight and closed

    # -- the pass --------------------------------------------------------------

    def run(self, at: int, end: int) -> None:
        text, levels = self.text, [Level("")]
        level = levels[0]
        base = len(self.undo)
        indents: list[tuple[int, str]] = []  # names of lines that end in a colon
        scopes: list[tuple[int, int]] = []  # indent and mark of def and class
        fresh, line = True, at  # whether the line has held no token yet

        def around() -> tuple[str, ...]:
            out = [n for x in levels[-8:] for n in x.names]
            return (*[n for _, n in indents[-8:]], *out)

        def pair(names: tuple[str, ...], nodes: list[int], rows: list[int]) -> None:
            label = level.label if any(n.lower() in _VALUES for n in names) else None
            told = (*names, label) if label else names
            for row in rows:
                self.found(told, around(), row)
            if nodes:
                node = self.joined(nodes)
                self.found(told, around(), node)
                for n in names:
                    self.learn(n, node)
                    if level.names and n.count(".") < 4:
                        level.members.append((n, node))

        while at < end:
            m = _MAIN.match(text, at, end)
            kind, start, at = m.lastgroup, m.start(), m.end()
            if kind == "space":
                continue
            if kind == "line":
                level.begin()
                fresh, line = True, at
                continue
            if fresh:
                indent = start - line
                while scopes and indent <= scopes[-1][0]:
                    self.back(scopes.pop()[1])
                while indents and (indent < indents[-1][0] or indent == indents[-1][0] and kind != "dash"):
                    indents.pop()
                if kind == "name" and _SCOPE.match(text, start, end):
                    scopes.append((indent, len(self.undo)))
                if kind == "dash" and m[0] == "-":
                    level.label = None
                    item = _SPACE.match(text, at, end).end()
                    got = self.next_term(item, end)
                    if indents and item > at and got and not _ANOTHER.match(text, got, end):
                        nodes, rows, at = self.value(item, end, ":", False, False)
                        pair((indents[-1][1],), nodes, rows)
                        continue
                fresh = False
            if kind == "name":
                level.recent.append(("name", m[0][-NAME:], at))
                level.recent = level.recent[-6:]
                level.query = text[start - 1 : start] in ("?", "&") if start else False
                if start >= 2 and text[start - 2 : start] == "--" and text[at : at + 1] in (" ", "=") and (term := self.next_term(at + 1, end)):
                    if not _ANOTHER.match(text, term, end) and text[at + 1] not in "-":
                        nodes, rows, at = self.value(at + 1, end, "=", False, True)
                        pair((m[0][-NAME:],), nodes, rows)
            elif kind in ("quoted", "triple"):
                width = 3 if kind == "triple" else 1
                inside = text[max(start + width, at - width - NAME) : at - width]
                if kind == "quoted" and (_ANOTHER.match(text, at, end) or text[at : at + 1] == "]"):
                    level.recent.append(("key", inside, at))  # a name, if an operator follows
                    level.recent = level.recent[-6:]
                    if text[at : at + 1] != "]":
                        continue
                    if level.kind == "[" and not level.direct:
                        continue
                got = self.term(start, end)
                if not got:
                    continue
                nodes, at, rows = got
                names = level.pending or (level.names if level.direct else ())
                if level.first is not None and level.kind == "(":
                    names = (*names, level.first)
                if names:
                    for node in nodes if rows else [self.joined(nodes)] if nodes else []:
                        self.found(names, around(), node)
                if not level.recent and not level.pending:
                    level.recent.append(("key", inside, at))
            elif kind == "op":
                names = self.named(m[0], level)
                if m[0] == ":" and names and level.typed is None:
                    level.typed = names[0]
                if not names:
                    continue
                place = _SPACE.match(text, at, end).end()
                typed = level.typed is not None and m[0] == "=" and not level.query
                follows = text[place : place + 1]
                if m[0] == ":" and (follows in ("", "\n", "\r")):
                    if levels[-1].kind == "":
                        indents.append((self.indent(line, end), names[0]))
                    continue
                tight = text[start - 1] not in " \t" and place == at
                nodes, rows, stop = self.value(place, end, m[0], typed, tight)
                # a type, if = follows
                ahead = _SPACE.match(text, stop, end).end()
                if m[0] == ":" and stop > place and text[ahead : ahead + 1] == "=" and text[ahead + 1 : ahead + 2] not in ("=", ">"):
                    level.typed = names[0]
                    at = place
                    continue
                if any(n.lower() in _LABELS for n in names):
                    word = _BARE.match(text, place, end)
                    s, e = (self.literals[nodes[0]] if len(nodes) == 1 else None) or (word.span() if word else (0, 0))
                    level.label = text[max(s, e - NAME) : e] or None
                pair(names, nodes, rows)
                level.pending = names
                at = max(stop, at)
                if stop == place:
                    level.recent = []
            elif kind == "open":
                if level.pending and not level.angle:
                    names, direct = level.pending, True
                elif m[0] == "(" and level.recent and level.recent[-1][0] == "name" and level.recent[-1][2] == start:
                    names, direct = (level.recent[-1][1],), True
                else:
                    names, direct = (), level.direct
                child = Level(m[0], names, direct)
                if m[0] == "{":
                    child.mark = len(self.undo)
                levels.append(child)
                level = child
            elif kind == "close":
                if len(levels) > 1:
                    gone = levels.pop()
                    level = levels[-1]
                    if gone.mark is not None:
                        self.back(gone.mark)
                        for name, node in gone.members:
                            for outer in gone.names:
                                self.learn(f"{outer}.{name}", node)
                                if level.names and name.count(".") < 3:
                                    level.members.append((f"{outer}.{name}", node))
                    if gone.kind == "[" and gone.recent and gone.recent[-1][0] == "key":
                        level.recent.append(("key", gone.recent[-1][1], at))
            elif kind == "angle":
                if m[0] == ">":
                    level.label = None
                level.angle = max(0, level.angle + (1 if m[0] == "<" else -1))
            elif kind == "end" and not (m[0] == "," and level.angle):
                if m[0] == "," and level.kind == "(":
                    level.first = level.recent[0][1] if len(level.recent) == 1 and level.recent[0][0] == "key" else None
                level.begin()
        for _, mark in scopes:
            self.back(max(mark, base))

    def indent(self, line: int, end: int) -> int:
        return _SPACE.match(self.text, line, end).end() - line

    def named(self, op: str, level: Level) -> tuple[str, ...]:
        """The names that an operator gives a value to."""
        if not level.recent:
            return (level.typed,) if op == "=" and level.typed else ()
        last = level.recent[-1][1]
        if op == "=" and level.typed is not None:
            return (level.typed, last)
        if op != "=" or len(level.recent) < 2:
            return (last,)
        words = [(k, w) for k, w, _ in level.recent if w not in _WORDS]
        # name T = x: the last two words, of which either may be the name
        if len(words) == 2 and all(k == "name" for k, _ in words):
            return (last, words[0][1])
        return (last,)


def covered_by(spans: list[tuple[int, int]]) -> Callable[[int, int], bool]:
    """Whether one of the spans (sorted by start) holds a stretch."""
    starts, reach, most = [s for s, _ in spans], [], -1
    for _, e in spans:
        most = max(most, e)
        reach.append(most)

    def covered(start: int, end: int) -> bool:
        i = bisect_right(starts, start) - 1
        return i >= 0 and reach[i] >= end

    return covered
