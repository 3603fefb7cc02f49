"""Finding and masking personal data: e-mail, URL, IBAN, card, date and phone.

The kinds are masked in this order, so none is found within another's mask; masks have no
digit and no @, so a second pass changes nothing. E-mail, URL, date and most of the phone
rules are regular expressions; IBAN and card candidates are checked by a small helper.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lengths of IBANs by country.
IBAN_LENGTH = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "HU": 28, "IE": 22, "IT": 27, "LI": 21, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24, "SI": 19, "SK": 24}
KINDS = ("email", "url", "iban", "card", "date", "phone")

#: One part of a host name, and of the local part of an address (RFC 5321, without quoted forms).
_HOST = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}(?<!-))?"
_ATOM = r"[A-Za-z0-9_%+-]+"
EMAIL = rf"(?<![A-Za-z0-9_.%+-]){_ATOM}(?:\.{_ATOM})*@(?:{_HOST}\.)+[A-Za-z]{{2,63}}(?![A-Za-z0-9_])"
URL = r"(?i)\b(?:https?://|www\.)[^\s<>(),;]+"
_LETTERS_DIGITS = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z]{2}[0-9]{2}(?=[A-Za-z0-9 ])")
_DIGIT_GROUPS = re.compile(r"(?<![A-Za-z0-9_])[0-9]+(?:[ -][0-9]+)*(?![A-Za-z0-9_])")
_DATE = re.compile(r"(?<![A-Za-z0-9_])(?:(\d{4})-(\d{2})-(\d{2})|(\d{1,2})[./](\d{1,2})[./](\d{4}|\d{2}))(?![A-Za-z0-9_])")
_CHAIN = re.compile(r"\d(?:[ ./()-]{0,2}\d)*")
_SHADOW = str.maketrans("   ‑–−", "   ---")
_RANGE = re.compile("[–−]")

#: Digits of the longest telephone number.
PHONE_DIGITS = 16

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    doubled = (int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits)))
    return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0


def ibans(text: str) -> Iterator[Span]:
    """Places that have the form of an account number: as many letters and digits as its country's have.

    Blanks may stand between groups of capitals; of countries without a known length, 15 to 34 characters count.
    """
    at = 0
    for start in _LETTERS_DIGITS.finditer(text):
        if start.start() < at:
            continue
        low, known = start.start(), IBAN_LENGTH.get(text[start.start() : start.start() + 2].upper())
        end, count, best = low, 0, 0
        while end < len(text) and count < (known or 34):
            c = text[end]
            if c == " " and text[end + 1 : end + 2].isalnum() and text[end + 1 : end + 2].isascii():
                if not text[low:end].isupper():
                    break
                best = end if not known and count >= 15 else best
            elif c.isascii() and c.isalnum():
                count += 1
            else:
                break
            end += 1
        whole = not text[end : end + 1].isalnum() and text[end : end + 1] != "_"
        if whole and (count == known if known else count >= 15) and (" " not in text[low:end] or text[low:end].replace(" ", "").isupper()):
            best = end
        if best:
            yield low, best
            at = best


def cards(text: str, original: str) -> Iterator[Span]:
    """Runs of whole digit groups, 13 to 19 digits with a right check digit, those of most groups first; never across a dash of a range.

    Each group is the first of at most 19 groups; sums up to each digit give every check in one step.
    """
    for run in _DIGIT_GROUPS.finditer(text):
        edges = [m.span() for m in re.finditer(r"\d+", text[run.start() : run.end()])]
        if edges[-1][1] < 13:
            continue
        sums, seen, ranges, at = ([0], [0]), [0], [0], 0
        for low, high in edges:
            for c in text[run.start() + low : run.start() + high]:
                d = int(c)
                twice = 2 * d - 9 if d > 4 else 2 * d
                sums[at % 2].append(sums[at % 2][-1] + twice)
                sums[1 - at % 2].append(sums[1 - at % 2][-1] + d)
                at += 1
            seen.append(at)
            ranges.append(ranges[-1] + (original[run.start() + high : run.start() + high + 1] in ("–", "−")))
        found, first = [], 0
        for i, (low, _) in enumerate(edges):
            while first < len(seen) and seen[first] - seen[i] < 13:
                first += 1
            for j in range(first, min(len(edges), i + 19) + 1):
                if seen[j] - seen[i] > 19 or edges[j - 1][1] - low > 40 or ranges[j - 1] > ranges[i]:
                    break
                # the last digit counts once, so digits of the other parity of place count twice
                total = sums[seen[j] % 2]
                if (total[seen[j]] - total[seen[i]]) % 10 == 0:
                    found.append((i - j, i, j))
        taken = bytearray(len(edges))
        for _, i, j in sorted(found):
            if not any(taken[i:j]):
                taken[i:j] = b"\1" * (j - i)
                yield run.start() + edges[i][0], run.start() + edges[j - 1][1]


def dates(text: str) -> Iterator[Span]:
    """Printed days that a calendar may have, in either order of day and month."""
    for m in _DATE.finditer(text):
        y, month, day, a, b, _ = m.groups()
        month, day = (int(month), int(day)) if y else sorted((int(a), int(b)))
        if 1 <= month <= 12 and 1 <= day <= 31:
            yield m.span()


def _is_phone(number: str, original: str) -> bool:
    """Whether groups of digits are written as a telephone number: international, with a leading zero, or three, three and four digits."""
    groups = re.findall(r"\d+", number)
    n = sum(map(len, groups))
    if number[0] == "+":
        return 7 <= n <= 16
    ranged = bool(_RANGE.search(original))
    if number[0] == "0" and not ranged:
        return 7 <= n <= 14 and (len(groups) > 1 or n < 9)
    if [len(g) for g in groups[-3:]] == [3, 3, 4] and (len(groups) == 3 or (len(groups) == 4 and groups[0] == "1")):
        between = re.findall(r"[^\d]+", number.strip("("))
        return number[0] == "(" and between[0] in (")", ") ") and between[1] in "-." or not ranged and all(x in ".-" for x in between)
    return False


def phones(text: str, original: str) -> Iterator[Span]:
    """The longest leading groups of each number that are a telephone number; none has more than ``PHONE_DIGITS`` digits."""
    for chain in _CHAIN.finditer(text):
        groups = [(m.start() + chain.start(), m.end() + chain.start()) for m in re.finditer(r"\d+", chain[0])]
        sizes = [high - low for low, high in groups]
        left, k = sum(sizes), 0
        while k < len(groups) and left >= 6:
            low, hit = groups[k][0], None
            if text[low - 1 : low] in ("+", "(") and low and not (text[low - 2 : low - 1].isdigit() or text[low - 2 : low - 1] == "+"):
                low -= 1
            if text[low - 1 : low] != "+" or not low:
                last, digits = k, 0
                while last < len(groups) and digits + sizes[last] <= PHONE_DIGITS:
                    digits += sizes[last]
                    last += 1
                if text[low] not in "+0":  # then it has three groups at the end and one at most before
                    last = min(last, k + 4)
                    last = last if any(sizes[j - 2 : j + 1] == [3, 3, 4] for j in range(k + 2, last)) else k
                hit = next((j for j in range(last - 1, k - 1, -1) if _is_phone(text[low : groups[j][1]], original[low : groups[j][1]])), None)
            if hit is not None:
                yield low, groups[hit][1]
            upto = k + 1 if hit is None else hit + 1
            left -= sum(sizes[k:upto])
            k = upto


_STEPS: tuple[tuple[str, Callable[[str, str], Iterator[Span]]], ...] = (
    ("email", lambda t, o: (m.span() for m in re.finditer(EMAIL, t))), ("url", lambda t, o: (m.span() for m in re.finditer(URL, t))), ("iban", lambda t, o: ibans(t)),
    ("card", lambda t, o: iter(sorted(cards(t, o)))), ("date", lambda t, o: dates(t)), ("phone", phones),
)


def redact(text: str, by_character: bool = False) -> tuple[str, dict[str, int]]:
    """The masked text and how often each kind was masked."""
    counts = {}
    for kind, find in _STEPS:
        out, at, n = [], 0, 0
        for low, high in find(text.translate(_SHADOW), text):
            out += [text[at:low], "█" * (high - low) if by_character else f"[{kind.upper()}]"]
            at, n = high, n + 1
        text, counts[kind] = "".join([*out, text[at:]]), n
    return text, counts


def found(text: str) -> Iterator[tuple[str, int, int, str]]:
    """Kind, place (in characters, from 0), length and original of all personal data of a text, each place once."""
    original, hits = text, []
    for kind, find in _STEPS:
        spans = list(find(text.translate(_SHADOW), text))
        hits += [(kind, low, high - low, original[low:high]) for low, high in spans]
        out, at = [], 0
        for low, high in spans:
            out += [text[at:low], "█" * (high - low)]
            at = high
        text = "".join([*out, text[at:]])
    return iter(sorted(hits, key=lambda h: h[1]))


def redacted(documents: DataFrame, by_character: bool = False) -> DataFrame:
    """Every document's masked text and counts, a column for each kind. Only texts with a digit or @ or www reach Python."""

    @F.pandas_udf("struct<text:string," + ",".join(f"{k}:int" for k in KINDS) + ">")
    def mask(texts: pd.Series) -> pd.DataFrame:
        made = [redact(t or "", by_character) for t in texts]
        return pd.DataFrame([{"text": t, **c} for t, c in made])

    may = F.col("text").rlike(r"[0-9@]|(?i)www\.")
    some = documents.where(may).select("doc_id", mask("text").alias("m")).select("doc_id", "m.*")
    none = documents.where(~F.coalesce(may, F.lit(False))).select("doc_id", "text", *[F.lit(0).alias(k) for k in KINDS])
    return some.unionByName(none)


def counts(text: Column) -> list[Column]:
    """How often a text has an e-mail address and, beside these, a URL; without Python."""
    return [F.regexp_count(text, F.lit(EMAIL)).alias("emails"), F.regexp_count(F.regexp_replace(text, EMAIL, "[EMAIL]"), F.lit(URL)).alias("urls")]


#: Masks of named entities by category.
ENTITIES = {"name": "[NAME]", "address": "[ADDRESS]", "org": "[ORG]", "other": "[REDACTED]"}


def swept(text: str, entities: list[tuple[str, str]], by_character: bool = False) -> tuple[str, dict[str, int], int, int]:
    """The text with every place of the entities (string, category) masked: found on the text as given, the earlier place first, at one place the longer.

    Also gives how many distinct entities of each category were found, how many places were
    masked, and how many entities were dropped: of fewer than three characters, without a letter,
    or not in the text.
    """
    found, places, dropped = dict.fromkeys(ENTITIES, 0), [], 0
    for needle, category in dict(reversed([(e, c) for e, c in entities if e])).items() if entities else ():
        if len(needle.strip()) < 3 or not any(c.isalpha() for c in needle) or needle not in text:
            continue
        found[category] += 1
        places += [(m.start(), -len(needle), category) for m in re.finditer(re.escape(needle), text)]
    good = {e for e, _ in entities if len(e.strip()) >= 3 and any(c.isalpha() for c in e) and e in text}
    dropped = sum(e not in good for e, _ in entities)
    out, at, masked = [], 0, 0
    for low, minus, category in sorted(places):
        if low >= at:
            out += [text[at:low], "█" * -minus if by_character else ENTITIES[category]]
            at, masked = low - minus, masked + 1
    return "".join([*out, text[at:]]), found, masked, dropped


def redacted_with(documents: DataFrame, entities: DataFrame, by_character: bool = False) -> DataFrame:
    """Documents with entities (doc_id, entity, category) swept and then all kinds masked, with the counts of both."""
    schema = f"struct<text:string,{','.join(f'{k}:int' for k in (*ENTITIES, *KINDS))},masked:int,dropped:int>"

    @F.pandas_udf(schema)
    def mask(texts: pd.Series, given: pd.Series) -> pd.DataFrame:
        rows = []
        for text, own in zip(texts, given, strict=True):
            once, found, masked, dropped = swept(text or "", [(e["entity"], e["category"]) for e in (own if own is not None else [])], by_character)
            final, counts = redact(once, by_character)
            rows.append({"text": final, **found, **counts, "masked": masked, "dropped": dropped})
        return pd.DataFrame(rows)

    lists = entities.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("entity", "category"))).alias("_given"))
    return documents.join(lists, "doc_id", "left").select("doc_id", mask("text", "_given").alias("m")).select("doc_id", "m.*")
