"""Printed invoices: totals, line items and what could not be read.

Every line is masked once (digits of dates, and of rates where totals are read, become signs that
no figure has, at the same place), cut at its figures, and classed as total, header, summary, item
or none of these. Totals go to the label right before each figure, items must pass the identity
quantity x price = total before a quantity is split off, and a total that was read from a bare
number stays only if no check speaks against it or one speaks for it. What can't be read for
certain is counted, never guessed.

Lines are read in Python, a document at a time and next to its other texts, so that its currency
and its unread lines are known without dealing out its lines; a line costs some microseconds, where
column expressions took ten times that. Blanks, digits and line ends are those of the engine's patterns.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import batches
from lectern.functions import money as M
from lectern.operators import statement

#: Words beside a figure on a line of totals, lower case.
FILLER = (
    "inkl", "incl", "including", "zzgl", "plus", "excl", "exkl", "excluding", "ohne", "vor", "davon",
    "ust", "mwst", "vat", "steuer", "umsatzsteuer", "mehrwertsteuer", "tax", "net", "netto", "brutto", "gross", "gesamt", "summe", "betrag", "total", "amount", "sum", "saldo", "zwischensumme",
    "per", "am", "zum", "vom", "as", "of", "dated", "stand",
    "der", "die", "das", "den", "des", "und", "and", "the",
    "eur", "usd", "gbp", "chf", "jpy", "cad", "aud", "nzd", "sek", "nok", "dkk", "pln", "czk", "huf",
)
#: Marks of a total without tax.
WITHOUT_TAX = ("excl", "exkl", "excluding", "net of tax", "before tax", "ohne steuer", "ohne ust", "ohne umsatzsteuer", "ohne mwst", "vor steuer")
#: What follows the label of a customer's number, and is no name.
NUMBERS = ("number", "no", "nr", "nummer", "reference", "ref", "id")

#: What is read of a line, beside its document's id.
FIELDS = "pos int, line string, kind string, currency string, description string, quantity double, tax_rate double, unit_price long, cents long, labels array<string>, amounts array<long>, weak boolean, rate double, dropped long"
_ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}
_TYPES = {name: _ARROW[kind] for name, kind in (field.split(" ") for field in FIELDS.split(", "))}
#: Documents (or texts of one document) beyond these bytes are read line by line, not kept as rows until their end.
LARGE = 4 << 20
_ROWS = 1 << 13
_LONG = (1 << 63) - 1

_EDGE = r"(?![^\W_])"
_START = r"(?<![^\W_])"
_SPACE = r" \t\n\x0b\f\r"  # blanks of the engine's patterns are ASCII
_BREAKS = r"\r\u0085\u2028\u2029"
_LINE = rf"[^\n{_BREAKS}]"
_END = rf"(?=[{_BREAKS}]?\Z)"
_SIGNS = "0123456789./-,'"
_HIDDEN = "".join(chr(0xE000 + i) for i in range(len(_SIGNS)))
_HIDE, _SHOW = str.maketrans(_SIGNS, _HIDDEN), str.maketrans(_HIDDEN, _SIGNS)


def _folded(words: Iterable[str]) -> str:
    """Words as a pattern that takes ASCII letters, and no others, in either case."""
    return "|".join("".join(f"[{c}{c.upper()}]" if c.isascii() and c.isalpha() else re.escape(c) for c in w) for w in words)


def _any_of(words: Iterable[str]) -> str:
    return "|".join(re.escape(w) for w in words)


_FIGURE_TEXT = rf"(?<![^\W_])(?<![.,])(?:\([{_SPACE}]?)?[-+]?[{_SPACE}]?(?:[0-9]{{1,3}}(?:[.,' ][0-9]{{3}})+(?:[.,][0-9]{{2}})?|[0-9]+[.,][0-9]{{2}})(?:[{_SPACE}]?\)|-)?(?![^\W_]|[.,][0-9])"
_FIGURE = re.compile(_FIGURE_TEXT)
#: A figure from its first digit on, and what may stand before that; a search that begins with a digit is several times as fast.
_FROM_DIGIT = re.compile(rf"[0-9](?<![^\W_].)(?<![.,].)(?:[0-9]{{0,2}}(?:[.,' ][0-9]{{3}})+(?:[.,][0-9]{{2}})?|[0-9]*[.,][0-9]{{2}})(?:[{_SPACE}]?\)|-)?(?![^\W_]|[.,][0-9])")
_BLANKS = " \t\n\x0b\f\r"
_MAY_BE_BEFORE = frozenset(_BLANKS + "-+(")
_BEFORE = frozenset(a + b + c for a in ("", "(", *("(" + x for x in _BLANKS)) for b in ("", "-", "+") for c in ("", *_BLANKS))
_UNIT_ENDS = frozenset("0123456789xX×.kKcCsStT")
#: Line ends, and characters that hide digits: lines with them are read by patterns alone.
_ODD = re.compile(rf"[{_BREAKS}\ue000-\uf8ff]")
_DATE_TEXT = M.DATE.replace(r"\d", "[0-9]")
_DATE = re.compile(_DATE_TEXT)
_DATES = re.compile(rf"(?<![0-9.])(?:{_DATE_TEXT})(?![0-9])")
_DIGIT = re.compile("[0-9]")
_RATE = re.compile(rf"[0-9][0-9.,']*[{_SPACE}]*%")
_PERCENT = re.compile(rf"([0-9]+(?:[.,][0-9]+)?)[{_SPACE}]*%")
_FROM_FIGURE = re.compile(rf"((?:[A-Z]{{3}}|[€$£¥])?[{_SPACE}]?{_FIGURE_TEXT}{_LINE}*){_END}")
_CURRENCY_CODE = re.compile(rf"(?:{'|'.join(M.CURRENCIES)})(?<![^\W_]...){_EDGE}")
_SIGN = re.compile("[€$£¥]")
_BEHIND = rf"[{_SPACE}.:;#/\\()€$£¥%{_HIDDEN}-]"
_BETWEEN = re.compile(rf"[0-9][0-9.,'%]*|{_BEHIND}+|{_START}(?:{'|'.join(FILLER)})(?=[{_SPACE}.:;#/\\()€$£¥%{_HIDDEN}0-9-]|\Z)")
_LABELS = {kind: _any_of(labels) for kind, labels in statement.TOTALS.items()}
_WITHIN = {kind: re.compile(rf"{_START}(?:{x}){_EDGE}") for kind, x in _LABELS.items()}
_LEADING = {kind: re.compile(rf"(?:{x}){_EDGE}") for kind, x in _LABELS.items()}
_EVERY = [x for labels in statement.TOTALS.values() for x in labels]
_LABELLED = re.compile(rf"[{''.join(sorted({x[0] for x in _EVERY}))}](?<![^\W_].)(?:{'|'.join(f'(?<={x[0]}){re.escape(x[1:])}' for x in _EVERY)}){_EDGE}")
_LEADS = re.compile(rf"(?:{'|'.join(_LABELS.values())}){_EDGE}")
_WORD = re.compile(r"[^\W_]+")
#: The first words of labels: one stands between edges, so a line that begins with another word does not begin with a label.
_FIRST = frozenset(_WORD.match(x).group() for x in _EVERY)
_FIRST_OF_TITLE = frozenset(_WORD.match(x).group() for labels in statement.HEADER.values() for x in labels)
_WITHOUT = re.compile(rf"(?<!\w)(?:{_any_of(WITHOUT_TAX)})|{_START}nett?o?{_EDGE}")
_LEADING_DATES = re.compile(rf"(?:[\ue000-\uf8ff]+[{_SPACE}]+){{1,2}}")
_SIGNED = re.compile("[-+()]")
_TWO = re.compile(rf"[.,][0-9]{{2}}{_END}")
_BARE = re.compile(rf"[{_SPACE}]*[-+(]?[0-9][0-9.,']*\)?[{_SPACE}]*{_END}")
_BESIDE = re.compile(rf"((?:[A-Z]{{3}}|[€$£¥])[{_SPACE}]?){_END}")
_CURRENCY_LAST = re.compile(rf"[{_SPACE}]*(?:[A-Z]{{3}}|[€$£¥])[{_SPACE}]*{_END}")
_SHAPED = re.compile(rf"[.,][0-9]{{2}}[){_SPACE}-]*{_END}")
_TITLE = re.compile(rf"(?:{_any_of(x for labels in statement.HEADER.values() for x in labels)}){_EDGE}")
_HEADER = {kind: re.compile(rf"(?:{_folded(labels)}){_EDGE}[{_SPACE}.:#-]*([^{_SPACE}]{_LINE}*){_END}") for kind, labels in statement.HEADER.items()}
_NUMBERED = re.compile(rf"(?:{_folded(NUMBERS)}){_EDGE}")
_UNITS = r"(?:[xX]|×|" + _folded(["stk"]) + r"\.?|" + _folded(["stück"]) + "|[pP][cC][sS]?" + r"\.?|" + _folded(["unit"]) + "[sS]?"
_COLUMNS = re.compile(rf"({_LINE}*?)[{_SPACE}]+([0-9]+)[{_SPACE}]+([0-9]+(?:[.,][0-9]+)?)[{_SPACE}]*%[{_SPACE}]*{_END}")
_TRAIL = re.compile(rf"({_LINE}*?)[{_SPACE}]+([0-9]+(?:[.,][0-9]+)?)[{_SPACE}]*({_UNITS}))?[{_SPACE}]*{_END}")
_LEAD = re.compile(rf"([0-9]+)[{_SPACE}]*{_UNITS}|[hH]|{_folded(['std'])}\.?)[{_SPACE}]+([^\W\d_]{_LINE}*){_END}")
_ROW_NUMBER = re.compile(rf"[0-9]{{1,3}}[{_SPACE}]+")
_NO_FIGURE = re.compile("[^0-9.,]")
_INTEGER = rf"(?:\([{_SPACE}]*)?-?(?<![0-9.,])[0-9]+(?![0-9]|[.,][0-9])(?:[{_SPACE}]*\)|-)?"
_CODES = "|".join(M.CURRENCIES)
_INTEGERS = re.compile(rf"(?:[€$£¥][{_SPACE}]*|{_START}(?:{_CODES})[{_SPACE}]+){_INTEGER}|{_INTEGER}[{_SPACE}]*(?:[€$£¥]|(?<=[{_SPACE}])(?:{_CODES}){_EDGE})")
_ONE_INTEGER = re.compile(_INTEGER)


def _places(text: str) -> list[tuple[int, int]]:
    """Where the figures of a text begin and end, as a search for ``money.FIGURE`` finds them."""
    found, end = [], 0
    for core in _FROM_DIGIT.finditer(text):
        start = core.start()
        if start > end and text[start - 1] in _MAY_BE_BEFORE:
            second = text[start - 2] if start > 1 else ""
            if second == " " and start > 2 and text[start - 3] not in _MAY_BE_BEFORE:
                start -= 1
            elif second and second not in _MAY_BE_BEFORE:
                start -= not (second.isalnum() or second in ".,")
            else:
                for at in range(max(end, start - 4), start):
                    if text[at:start] in _BEFORE and not (at and (text[at - 1].isalnum() or text[at - 1] in ".,")):
                        start = at
                        break
        end = core.end()
        found.append((start, end))
    return found


def _without(text: str, places: list[tuple[int, int]]) -> str:
    """A text with a blank for each figure."""
    at, kept = 0, []
    for start, end in places:
        kept.append(text[at:start])
        at = end
    return " ".join([*kept, text[at:]])


def _amount(raw: str) -> int | None:
    """``money.amount`` of a figure or a whole number in Python; null too beyond the range of a long."""
    s = raw.strip(" ")
    number = s.replace(".", "").replace(",", "")
    if not (number.isascii() and number.isdigit()):
        negative = s.startswith("-") or s.rstrip(_BLANKS).endswith("-") or (s.startswith("(") and s.endswith(")"))
        digits = _NO_FIGURE.sub("", s)
        value = _amount(digits) if digits else None
        return -value if negative and value is not None else value
    if s[-3:-2] in (".", ","):
        value = int(number)
        return value if value <= _LONG else None
    at = max(s.rfind("."), s.rfind(","))
    size = len(s) - at - 1 if at >= 0 else 0
    if at < 0 or (size == 3 and not ("." in s and "," in s)):
        value = int(number) * 100
    else:
        value = int(number) if size == 2 else (200 * int(number) + 10**size) // (2 * 10**size)
    return value if value <= _LONG else None


def _currency(text: str) -> str | None:
    """``money.currency`` in Python."""
    found = _CURRENCY_CODE.search(text)
    if found:
        return found.group()
    if "$" in text or (not text.isascii() and _SIGN.search(text)):
        return next(code for mark, code in M.SIGNS if mark in text)
    return None


def _currency_beside(before: str, region: str) -> str | None:
    """The currency of a code or sign right before a figure, and of the text from the figure on."""
    before = before[:-1] if before and before[-1] in _BLANKS else before
    code = before[-3:]
    if len(code) == 3 and code.isascii() and code.isalpha() and code.isupper():
        return code if code in M.CURRENCIES else _currency(f"{code} {region}")
    return _currency(f"{code[-1]} {region}" if code and code[-1] in "€$£¥" else region)


def _last_integer(line: str) -> int | None:
    found = _INTEGERS.findall(_DATES.sub(" ", line))
    one = _ONE_INTEGER.search(found[-1]) if found else None
    return _amount(one.group()) if one else None


def _double(text: str) -> float:
    return float(text.replace(",", "."))


def _percent(line: str) -> float | None:
    found = _PERCENT.search(line)
    return _double(found.group(1)) if found else None


def _only_filler(text: str) -> bool:
    return _BETWEEN.sub(" ", text.lower()).strip(" ") == ""


def _label_of(segment: str) -> str | None:
    """The kind of total that a text before a figure names, if it is that and filler; null otherwise."""
    low = segment.lower()
    return next((kind for kind, label in _WITHIN.items() if label.search(low) and _only_filler(label.sub(" ", low))), None)


def _hidden(found: re.Match) -> str:
    return found.group().translate(_HIDE)


def _vote(line: str) -> str | None:
    """The currency that any line with a digit votes for, as ``statement.with_currency`` counts it."""
    found = _FROM_FIGURE.search(_DATES.sub(" ", line))
    return _currency(found.group(1) if found else line)


def _names(line: str) -> bool:
    """Whether a line that begins with a title of a header gives what it names."""
    for kind, title in _HEADER.items():
        found = title.match(line)
        if found and (_DATE.search(found.group(1)) if "date" in kind else kind != "recipient" or not _NUMBERED.match(found.group(1))):
            return True
    return False


def _read(line: str) -> tuple:
    """A trimmed line's vote for a currency, its kind, and what it takes: of an item amounts, words, its own currency and the kind without any; of totals labels, amounts, weakness and rate."""
    low, digit = line.lower(), _DIGIT.search(line)
    odd = "\r" in line or (not line.isascii() and _ODD.search(line))
    first = _WORD.match(low)
    first = first.group() if first else ""
    dated, places, figures = line, (), []
    if digit:
        dates = (line.count("-") > 1 or line.count(".") + line.count("/") > 1) and _DATES.search(line)
        dated = _DATES.sub(_hidden, line) if dates else line
        places = shown = _places(dated)
        scan = dated
        rates = [r.span() for r in _RATE.finditer(dated)] if "%" in line else ()
        if rates:
            scan, at = "", 0
            for start, end in rates:
                scan, at = scan + dated[at:start] + dated[start:end].translate(_HIDE), end
            scan += dated[at:]
            # a figure that no rate touches is the same with the rates hidden
            if any(start < rate_end and end > rate_start - 3 for start, end in places for rate_start, rate_end in rates):
                shown = _places(scan)
        figures = [scan[a:b] for a, b in shown]
        if odd or dates:
            vote = _vote(line)
        else:
            vote = _currency_beside(line[max(0, places[0][0] - 4) : places[0][0]], line[places[0][0] :]) if places else _currency(line)
    else:
        vote = _currency(line)

    # a line of several labels: each figure belongs to the label right before it
    owners, multi = None, False
    if len(figures) >= 2 and _LABELLED.search(low):
        owners = [_label_of(scan[a:b]) for a, b in zip((0, *(e for _, e in shown)), (s for s, _ in shown))]
        multi = None not in owners and len(set(owners)) >= 2

    if first in _FIRST_OF_TITLE and _TITLE.match(low) and _names(line) and not (figures and (any(_SHAPED.search(f) for f in figures) or _currency(scan))):
        return vote, "header"
    if multi:
        return vote, "totals", owners, [_amount(f) for f in figures], False, None

    # a line of one label, and nothing but filler behind it
    if first in _FIRST and _LEADS.match(low):
        summary = False
        for kind, label in _LEADING.items():
            found = label.match(low)
            if found:
                behind = low[found.end() :]
                behind = _DATES.sub(" ", behind) if digit else behind
                if _only_filler(_without(behind, _places(behind)) if digit else behind):
                    kind = "net" if kind == "gross" and _WITHOUT.search(low) else kind
                    value = _amount(figures[-1]) if figures else None
                    return vote, "totals", [kind], [_last_integer(line) if value is None else value], not figures, _percent(line) if kind == "tax" else None
                behind = dated.lower()
                behind = behind[label.match(behind).end() :]
                until = _FIGURE.search(behind)
                summary = summary or _only_filler(behind[: until.start()] if until else behind)
        if summary:
            return vote, "summary"

    # an item: its figures with those of dates hidden
    if not places:
        return vote, "dropped" if figures else "words"
    none = "dropped" if figures else "words"
    leading = _LEADING_DATES.match(dated) if odd or dates else None
    rest = dated[leading.end() :] if leading else dated
    places = _places(rest) if leading else places
    if not places:
        return vote, none
    at, end = places[0][0], places[-1][1]
    amounts, before, region = figures if rest is scan else [rest[a:b] for a, b in places], rest[:at], rest[at:]
    if end < len(rest) and _BARE.match(rest[end:]):
        return vote, none
    for amount in amounts:
        if " " in amount and " " in amount.strip(" "):
            bare = _SIGNED.sub("", amount).strip(" ")
            if " " in bare and not _TWO.search(bare):
                return vote, none
    if odd:
        words = _CURRENCY_LAST.sub("", before.translate(_SHOW)).strip(" ")
        beside = _BESIDE.search(before)
        currency = _currency(((beside.group(1) if beside else "") + region).translate(_SHOW))
    else:
        words = (before.translate(_SHOW) if dates else before).rstrip(_BLANKS)
        code = words[-3:]
        if len(code) == 3 and code.isascii() and code.isalpha() and code.isupper():
            words = words[:-3].rstrip(_BLANKS).strip(" ")
        elif words and words[-1] in "€$£¥":
            words = words[:-1].rstrip(_BLANKS).strip(" ")
        else:
            words = before.translate(_SHOW).strip(" ") if dates else before.strip(" ")
        currency = _currency_beside(before, region.translate(_SHOW)) if dates else vote
    return (vote, "item", amounts, words, currency, none) if words else (vote, none)


def _item(amounts: list[str], words: str) -> tuple:
    """Description, quantity, tax rate, unit price and cents of an item."""
    cents, price = _amount(amounts[-1]), _amount(amounts[-2]) if len(amounts) >= 2 else None
    last = words.rstrip(_BLANKS)[-1:]
    odd = not words.isascii() or "\r" in words
    if price is not None:
        columns = _COLUMNS.match(words) if last == "%" or odd else None
        if columns and cents is not None:
            clean = _ROW_NUMBER.match(columns.group(1))
            clean = (columns.group(1)[clean.end() :] if clean else columns.group(1)).strip(" ")
            n = int(columns.group(2))
            if clean and n <= _LONG and n * price == cents:
                return clean, _double(columns.group(2)), _double(columns.group(3)), price, cents
        lead = _LEAD.match(words)
        if lead and lead.group(2)[0].isalpha():
            return lead.group(2), _double(lead.group(1)), None, price, cents
    trail = _TRAIL.match(words) if last in _UNIT_ENDS or odd else None
    if trail and trail.group(1).strip(" ") and (trail.group(3) or price is not None):
        return trail.group(1).strip(" "), _double(trail.group(2)), None, price, cents
    return words, None, None, price, cents


def _lines(texts: Iterable[str | None]) -> Iterator[tuple[int, str]]:
    """The lines of plain texts that aren't blank, trimmed, with their position in their text."""
    for text in texts:
        if text is not None:
            at, pos = 0, 0
            while at >= 0:
                end = text.find("\n", at)
                line = text[at:] if end < 0 else text[at : end - 1] if end > at and text[end - 1] == "\r" else text[at:end]
                line = line.strip(" ")
                if line:
                    yield pos, line
                at, pos = end + 1 if end >= 0 else -1, pos + 1


def _rows(texts: Iterable[str | None]) -> Iterator[tuple]:
    """Of every line its vote, position, text, kind, and what it takes; an item has what its kind is without any currency, its own one, and its fields, and a line of words right below goes on with its description."""
    held = None
    for pos, line in _lines(texts):
        read = _read(line)
        kind = read[1]
        if held is not None:
            yield held if kind != "words" or pos != held[1] + 1 else (*held[:6], f"{held[6]} {line}", *held[7:])
            held = None
        if kind == "item":
            held = (read[0], pos, line, kind, read[5], read[4], *_item(read[2], read[3]))
        else:
            yield (read[0], pos, line, *read[1:])
    if held is not None:
        yield held


class _Kept:
    """Texts of one document, in memory or beyond ``LARGE`` in a file."""

    def __init__(self):
        self.file, self.ends, self.size = tempfile.SpooledTemporaryFile(max_size=LARGE), [], 0

    def add(self, text: str | None) -> None:
        data = (text or "").encode()
        self.file.write(data)
        self.size += len(data)
        self.ends.append(len(data))

    def __iter__(self) -> Iterator[str]:
        self.file.seek(0)
        for n in self.ends:
            yield self.file.read(n).decode()


def _document(texts: Iterable[str | None], large: bool, kinds: frozenset[str]) -> Iterator[tuple]:
    """The rows of one document that are of the kinds, with how many of its lines were dropped.

    The currency of a document is that of most lines, on a tie that of the least position; without any, a line without one is no item.
    """
    kept = None if large else list(_rows(texts))
    votes: dict[str, list[int]] = {}
    dropped = bare = 0
    for row in _rows(texts) if large else kept:
        if row[0]:
            count = votes.setdefault(row[0], [0, -row[1]])
            count[0], count[1] = count[0] + 1, max(count[1], -row[1])
        if row[3] == "dropped":
            dropped += 1
        elif row[3] == "item" and row[4] == "dropped" and not row[5]:
            bare += 1
    currency = max(votes, key=votes.get) if votes else None
    dropped += 0 if currency else bare
    for _, pos, line, kind, *found in _rows(texts) if large else kept:
        if kind == "item":
            if found[1] or currency:
                if "item" in kinds:
                    yield pos, line, kind, found[1] or currency, *found[2:], None, None, None, None, dropped
                continue
            kind = found[0]
        if kind in kinds:
            yield (pos, line, kind, None, None, None, None, None, None, *(found if kind == "totals" else (None, None, None, None)), dropped)


KINDS = ("totals", "header", "summary", "item", "dropped", "words")


def classed(documents: DataFrame, kinds: Iterable[str] = KINDS) -> DataFrame:
    """Every line (doc_id, pos, line) with its ``kind`` and what totals and items need; with ``kinds`` lines of these only.

    Kinds: ``totals`` (of one label or several), ``header``, ``summary`` (a label of totals alone
    before its figure), ``item``, ``dropped`` (a figure that can't be read for certain) and ``words``.
    Items have ``currency``, ``description`` with the line of words right below, ``quantity``, ``tax_rate``,
    ``unit_price`` and ``cents``; totals have ``labels``, ``amounts``, ``weak`` and ``rate``; all have how many lines of
    their document were ``dropped``. Rows of one doc_id are one document, which votes for one currency.
    """
    plain = documents.select("doc_id", M.plain(F.col("text")).alias("text"))
    # the window brings the rows of a doc_id together, one behind the other, and says how many they are
    together = plain.withColumn("texts", F.count(F.lit(1)).over(W.partitionBy("doc_id")))
    schema = T.StructType([T.StructField("doc_id", plain.schema["doc_id"].dataType), *T.StructType.fromDDL(FIELDS)])
    kept = frozenset(kinds)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, made, rest, texts = [], [], 0, None

        def batch(key: pa.DataType) -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(ids, key), *(pa.array(c, t) for c, t in zip(zip(*made, strict=True), _TYPES.values(), strict=True))], names=["doc_id", *_TYPES])
            ids.clear()
            made.clear()
            return out

        for part in batches.parts(found, "text"):
            key_type = part.schema.field("doc_id").type
            for key, text, n in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "texts")), strict=True):
                if n == 1:
                    document, large = (text,), text is not None and len(text) > LARGE
                else:
                    if not rest:
                        rest, texts = n, _Kept()
                    texts.add(text)
                    rest -= 1
                    if rest:
                        continue
                    document, large = texts, texts.size > LARGE
                for row in _document(document, large, kept):
                    ids.append(key)
                    made.append(row)
                    if len(made) >= _ROWS:
                        yield batch(key_type)
        if made:
            yield batch(key_type)

    return together.mapInArrow(run, schema)


def items(rows: DataFrame, unread: bool = False) -> DataFrame:
    """Line items (doc_id, pos, description, quantity, tax_rate, unit_price, cents, currency) of classed lines.

    The last figure is the line's total, the one before it the unit price. ``2 20%`` behind the
    words is quantity and rate if quantity x price is the total, and a row number before them goes
    then too; a number with a unit before or behind the words is the quantity, one without a unit
    only behind them and beside a price. A line of words right below goes on with the description.
    With ``unread`` each has its document's ``dropped``, as ``unread`` counts them, without reading the lines again.
    """
    return rows.where("kind = 'item'").select("doc_id", "pos", "description", "quantity", "tax_rate", "unit_price", "cents", "currency", *(["dropped"] if unread else []))


def totals(rows: DataFrame) -> DataFrame:
    """Net, tax and gross in cents and the printed rate in percent; the last reading of a kind counts.

    A reading from a bare number beside a currency is weak: it goes if a check that it takes part
    in fails and none holds. Checks: items make the net (in one currency), net and tax the gross,
    the rate the tax.
    """
    found = rows.where("kind IN ('totals', 'item')")
    item = F.col("kind") == "item"
    total = F.transform(F.arrays_zip("labels", "amounts"), lambda z, i: F.struct(z["labels"].alias("kind"), z["amounts"].alias("value"), F.col("weak").alias("weak"), i.alias("at")))
    total = F.when(item, F.array(F.struct(F.lit(None).cast("string").alias("kind"), F.col("cents").alias("value"), F.lit(False).alias("weak"), F.lit(0).alias("at")))).otherwise(total)
    read = found.select("doc_id", "pos", F.explode(total).alias("r"), "rate", "currency")
    place = F.struct("pos", "r.at")
    known = F.col("r.value").isNotNull()
    last = lambda kind, what: F.max_by(what, F.when((F.col("r.kind") == kind) & known, place))
    line = F.col("r.kind").isNull()
    both = read.groupBy("doc_id").agg(
        *(last(k, F.col("r.value")).alias(k) for k in statement.TOTALS), *(last(k, F.col("r.weak")).alias(f"{k}_weak") for k in statement.TOTALS), F.max_by("rate", F.when(F.col("rate").isNotNull(), place)).alias("rate"),
        F.sum(F.when(line, F.col("r.value"))).alias("items"), F.sum(line.cast("long")).alias("n"), F.size(F.collect_set("currency")).alias("currencies"),
    )
    net, tax, gross = F.col("net"), F.col("tax"), F.col("gross")
    checks = {
        "items": F.when(F.col("currencies") == 1, F.col("items") == net),
        "sum": net + tax == gross,
        "rate": F.abs(F.round(net * F.col("rate") / 100) - tax) <= F.greatest(F.lit(1.0), F.coalesce("n", F.lit(0)) * 0.5) + 0.5,
    }
    part = {"net": ("items", "sum", "rate"), "tax": ("sum", "rate"), "gross": ("sum",)}

    def kept(kind: str) -> Column:
        holds, fails = F.lit(False), F.lit(False)
        for name in part[kind]:
            holds, fails = holds | F.coalesce(checks[name], F.lit(False)), fails | F.coalesce(~checks[name], F.lit(False))
        return F.when(~F.coalesce(F.col(f"{kind}_weak") & fails & ~holds, F.lit(False)), F.col(kind))

    return both.select("doc_id", *(kept(k).alias(k) for k in statement.TOTALS), "rate").where("net IS NOT NULL OR tax IS NOT NULL OR gross IS NOT NULL")


def unread(rows: DataFrame) -> DataFrame:
    """How many lines with a figure of each document were read as nothing."""
    return rows.groupBy("doc_id").agg(F.sum((F.col("kind") == "dropped").cast("long")).alias("dropped"))
