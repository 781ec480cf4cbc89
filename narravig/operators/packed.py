"""Values packed in one text field, one row per value, by a parsing expression grammar.

    List      <- Mark? Item (Separator Mark? Item)*
    Item      <- Space* (Quoted / Bare) Space*
    Quoted    <- open (Escape / !close .)* close &(Space* (Separator / Mark / End))
    Bare      <- (Bracketed / !Separator !Mark .)*
    Bracketed <- '(' (Bracketed / !')' .)* ')'

The alternatives are tried in order. Where a quote or a bracket is never closed, its alternative fails and the parser
goes back and takes the sign as ordinary text; the value then carries a flag. The list is first read with the strong
separators (line end, semicolon, bar, tab, slash between spaces, list marks); only if none of them occurs outside
quotes and brackets it is read again with the comma.

Defined results: null and blank texts give no row; empty values give no row and take no position; equal values keep
their own positions; texts of any length are read in linear time; repeated rows are reported once; the input's other
columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narravig.functions.arrowmap import flat_map

QUOTES = {'"': '"', "'": "'", "“": "”", "„": "“", "«": "»", "‘": "’", "‹": "›", "「": "」", "『": "』"}
STRONG, WEAK = "\n\r;；|\t", ",，、"
BULLET = "•·‣▪●○◦■□–—*-"
MARK = re.compile(rf"(?:(?P<bullet>[{re.escape(BULLET)}])|(?P<open>\()?(?P<n>\d{{1,3}})(?P<close>[.)])|(?P<letter>[a-z])\))\s+")
SCHEMA = "key long, field string, pos long, item string, flag string"


class Parser:
    """Parses one text at one level of separators."""

    def __init__(self, text: str, weak: bool):
        self.text, self.weak, self.split = text, weak, False
        self.brackets = self._brackets()
        self.last_close: dict[str, int] = {}
        self.style: tuple | None = None
        self.number = 0
        self.lines = "\n" in text.strip()

    def _brackets(self) -> dict[int, int]:
        """The end of each closed bracket; a bracket that belongs to a mark at a line's start closes nothing."""
        marks = {m.end(1) - 1 for m in re.finditer(r"(?:^|\n)\s*(\(?\d{1,3}\))", self.text)}
        pairs, stack = {}, []
        for m in re.finditer(r"[()]", self.text):
            i = m.start()
            if m[0] == "(":
                stack.append(i)
            elif i in marks and not (stack and re.fullmatch(r"\(\d{1,3}\)", self.text[stack[-1] : i + 1])):
                continue
            elif stack:
                pairs[stack.pop()] = i
        return pairs

    def separator(self, i: int) -> int:
        """The end of the separator at i, or 0."""
        c = self.text[i]
        if self.weak:
            return i + 1 if c in WEAK else 0
        if c in STRONG:
            return i + 1
        if c == "/" and i and self.text[i - 1].isspace() and (i + 1 == len(self.text) or self.text[i + 1].isspace()):
            return i + 1
        return 0

    def mark(self, i: int, line_start: bool) -> int:
        """The end of the list mark at i, or 0. Within a line a mark must carry on the list's own marks."""
        if self.weak or not (m := MARK.match(self.text, i)):
            return 0
        style = (m["bullet"], m["open"], m["close"], bool(m["letter"]))
        number = int(m["n"]) if m["n"] else ord(m["letter"]) - 96 if m["letter"] else 0
        if m["letter"] and not (number == 1 and line_start or self.style == style and number == self.number + 1):
            return 0
        if not line_start:
            if m["bullet"]:
                if m["bullet"] in "-–—*" and (self.style != style or self.lines):
                    return 0
            elif self.style != style or number != self.number + 1:
                return 0
        self.style, self.number = style, number
        return m.end()

    def ends(self, i: int) -> bool:
        """Whether an item may end at i: nothing but space before a separator, a mark or the end."""
        while i < len(self.text) and self.text[i].isspace() and not self.separator(i):
            i += 1
        if i == len(self.text) or self.separator(i):
            return True
        was = self.style, self.number
        found = bool(self.text[i - 1].isspace() and self.mark(i, False))
        self.style, self.number = was
        return found

    def quoted(self, i: int) -> tuple[str, int] | None:
        close = QUOTES.get(self.text[i])
        if not close:
            return None
        if close not in self.last_close:
            self.last_close[close] = self.text.rfind(close)
        out, j, n = [], i + 1, len(self.text)
        last = self.last_close[close]
        while j <= last:
            c = self.text[j]
            if c == "\\" and j + 1 < n and self.text[j + 1] in (close, self.text[i]):
                out.append(self.text[j + 1])
                j += 2
            elif c == close and close == self.text[i] and self.text[j + 1 : j + 2] == close:
                out.append(c)
                j += 2
            elif c == close and self.ends(j + 1):
                return "".join(out).strip(), j + 1
            else:
                out.append(c)
                j += 1
        self.last_close[close] = min(last, i)
        return None

    def items(self) -> Iterator[tuple[str, str | None]]:
        text, n, i, line = self.text, len(self.text), 0, True
        while i <= n:
            while i < n and text[i].isspace() and not self.separator(i):
                i += 1
            if i < n and (end := self.mark(i, line)):
                self.split, i, line = True, end, False
                continue
            flag = None
            if i < n and text[i] in QUOTES:
                if got := self.quoted(i):
                    value, i = got
                    yield value, None
                    i, line = self.after(i)
                    continue
                flag = "open_quote"
            start = i
            while i < n:
                if i in self.brackets and not (i > start and text[i - 1].isspace() and self.peek(i)):
                    i = self.brackets[i] + 1
                    continue
                if self.separator(i) or i > start and text[i - 1].isspace() and self.peek(i):
                    break
                if text[i] == "(":
                    flag = flag or "open_bracket"
                i += 1
            yield text[start:i].strip(), flag
            i, line = self.after(i)

    def peek(self, i: int) -> int:
        was = self.style, self.number
        end = self.mark(i, False)
        self.style, self.number = was
        return end

    def after(self, i: int) -> tuple[int, bool]:
        """The start of the next item, past one separator, and whether it opens a line."""
        text, n = self.text, len(self.text)
        while i < n and text[i].isspace() and not self.separator(i):
            i += 1
        if i >= n:
            return n + 1, False
        if end := self.separator(i):
            self.split = True
            return end, True
        return i, False


def parse(text: str | None) -> list[tuple[str, str | None]]:
    """The values of a text in order, each with an error flag or None."""
    if text is None or not text.strip():
        return []
    for weak in (False, True):
        parser = Parser(text, weak)
        got = [(value, flag) for value, flag in parser.items() if value]
        if parser.split:
            break
    return got


def unpack(df: DataFrame, key: str, fields: dict[str, object]) -> DataFrame:
    """key, field, pos, item, flag for the values of each text column in ``fields`` (name: column)."""
    texts = F.explode(F.array(*(F.struct(F.lit(name).alias("field"), c.alias("text")) for name, c in fields.items())))
    each = df.select(F.col(key).cast("long").alias("key"), texts.alias("t")).where(F.length("t.text") > 0)

    def make():
        def rows(key, field, text):
            for pos, (item, flag) in enumerate(parse(text)):
                yield key, field, pos, item, flag

        return rows

    return flat_map(each, ["key", "t.field", "t.text"], make, SCHEMA).distinct()
