"""Secrets in texts: three fixed patterns, and windows of high Shannon entropy.

The patterns are read by built-in regular expressions. Candidate strings of each character class are then
swept by a window of fixed length whose entropy is kept up to date by counts: the character
that enters and the one that leaves change two counts and one running sum. Windows above the class's
limit are merged to spans. A window that overlaps an allow-listed part of its candidate is suppressed, and so are
candidates that are allowed as a whole. Spans may overlap those of the patterns, as a key right beside a pattern's match does; one that lies
within a pattern's span is left out, as nothing of it is new.

Everything is column expressions. Sums of n log2 n are whole numbers (scaled by 2^20), so results
don't depend on the order of additions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import let

ASSIGN = (
    "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "entropy")
SCALE = 1 << 20


@dataclass(frozen=True)
class CharacterClass:
    """Candidates are runs of ``alphabet`` of ``least`` characters that hold all of ``needs``."""

    name: str
    alphabet: str
    run: str
    least: int
    window: int
    bits: float
    needs: tuple[str, ...]

    def steps(self) -> list[int]:
        """Scaled n log2 n for n from 0 to the window's length."""
        return [round(SCALE * n * math.log2(n)) if n > 1 else 0 for n in range(self.window + 1)]

    def most(self) -> int:
        """The largest sum of n log2 n at which a window's entropy is ``bits`` or more."""
        return math.floor(SCALE * self.window * (math.log2(self.window) - self.bits))


_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = (
    CharacterClass("base64", _UPPER + _LOWER + _DIGITS + "+/_=-", "[A-Za-z0-9+/_=-]", 20, 20, 3.8, ("[0-9]", "[a-z]", "[A-Z]")),
    CharacterClass("hexadecimal", _DIGITS + "ABCDEF", "[0-9A-F]", 32, 32, 3.2, ("[0-9]", "[A-F]")),
    # Keys of one letter case with digits.
    CharacterClass("lower", _LOWER + _DIGITS, "[a-z0-9]", 20, 20, 3.5, ("[0-9]", "[a-z]")),
    CharacterClass("upper", _UPPER + _DIGITS, "[A-Z0-9]", 20, 20, 3.5, ("[0-9]", "[A-Z]")),
)
# Candidates that are no secrets: identifiers in the usual form of five groups, and strings that say that they are examples.
ALLOWED = (
    "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    "(?i)example|sample|placeholder",
    "0123456789|abcdefghij|ABCDEFGHIJ",
)

# Allowed as whole candidates, and as parts, which take out only the windows that overlap them.
ALLOWED_WHOLE = tuple(x for x in ALLOWED if x.startswith("^"))
ALLOWED_PART = "|".join(f"(?:{x})" for x in ALLOWED if not x.startswith("^"))

_SPAN = "struct<start:int,kind:int,end:int>"


def _none() -> Column:
    return F.array().cast(f"array<{_SPAN}>")


def _indices(count: Column) -> Column:
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def _matches(text: Column, pattern: str, kind: int, group: int = 0, least: int = 1) -> Column:
    """Spans of a pattern's leftmost non-overlapping matches whose ``group`` has ``least`` characters.

    The pieces between the matches and the matches themselves, laid end to end, give the positions.
    """

    def placed(found: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            start = state["at"] + F.length(F.get(found["gaps"], i))
            end = start + F.length(F.get(found["whole"], i))
            span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
            long_enough = F.length(F.get(found["part"], i)) >= least
            spans = F.when(long_enough, F.array_append(state["spans"], span)).otherwise(state["spans"])
            return F.struct(end.alias("at"), spans.alias("spans"))

        start = F.struct(F.lit(0).alias("at"), _none().alias("spans"))
        return F.aggregate(_indices(F.size(found["whole"])), start, step, lambda state: state["spans"])

    found = F.struct(
        F.split(text, pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"),
    )
    return F.when(text.rlike(pattern), let(found, placed)).otherwise(_none())


def _high_windows(candidate: Column, kind: CharacterClass) -> Column:
    """Merged spans, within a candidate, of the windows whose entropy reaches the class's limit."""
    steps = F.lit(kind.steps())
    width = kind.window

    def sweep(codes: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            enters, leaves = F.get(codes, i), F.get(codes, i - width)  # nothing leaves the first window

            def counted(n: Column) -> Column:
                gain = F.get(steps, n["enters"] + 1) - F.get(steps, n["enters"])
                loss = F.when(leaves.isNull(), 0).otherwise(F.get(steps, n["leaves"] - 1) - F.get(steps, n["leaves"]))
                total = F.when(leaves.eqNullSafe(enters), state["sum"]).otherwise(state["sum"] + gain + loss)
                counts = F.transform(
                    state["counts"],
                    lambda x, j: x + F.when(j == enters, 1).otherwise(0) - F.when(j.eqNullSafe(leaves), 1).otherwise(0),
                )
                high = (i >= width - 1) & (total <= kind.most())
                joins = high & (state["end"] >= i - width + 1)
                opens = high & ~joins
                return F.struct(
                    counts.alias("counts"),
                    total.alias("sum"),
                    F.when(opens, i - width + 1).otherwise(state["start"]).alias("start"),
                    F.when(high, i + 1).otherwise(state["end"]).alias("end"),
                    F.when(opens & (state["end"] >= 0), F.array_append(state["done"], F.struct(state["start"], state["end"])))
                    .otherwise(state["done"])
                    .alias("done"),
                )

            now = F.struct(
                F.get(state["counts"], enters).alias("enters"),
                F.coalesce(F.get(state["counts"], leaves), F.lit(0)).alias("leaves"),
            )
            return let(now, counted)

        start = F.struct(
            F.array_repeat(F.lit(0), len(kind.alphabet)).alias("counts"),
            F.lit(0).cast("long").alias("sum"),
            F.lit(-1).alias("start"),
            F.lit(-1).alias("end"),
            F.array().cast("array<struct<start:int,end:int>>").alias("done"),
        )
        return F.aggregate(
            _indices(F.size(codes)),
            start,
            step,
            lambda state: F.when(
                state["end"] >= 0, F.array_append(state["done"], F.struct(state["start"], state["end"]))
            ).otherwise(state["done"]),
        )

    letters = F.array_remove(F.split(candidate, "", -1), "")
    return let(F.transform(letters, lambda c: F.instr(F.lit(kind.alphabet), c) - 1), sweep)


def _pieces(candidate: Column) -> Column:
    """Spans of what lies between the allowed parts of a candidate: windows that overlap none of them lie in one."""

    def between(parts: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(parts, lambda x: x["end"]))
        ends = F.concat(F.transform(parts, lambda x: x["start"]), F.array(F.length(candidate)))
        return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end")))

    return let(_matches(candidate, ALLOWED_PART, KINDS.index("entropy")), between)


def _piecewise_windows(candidate: Column, kind: CharacterClass) -> Column:
    def of(piece: Column) -> Column:
        part = F.substring(candidate, piece["start"] + 1, piece["end"] - piece["start"])
        return F.transform(
            let(part, lambda p: _high_windows(p, kind)),
            lambda w: F.struct((piece["start"] + w["start"]).alias("start"), (piece["start"] + w["end"]).alias("end")),
        )

    return F.flatten(F.transform(_pieces(candidate), of))


def _entropy_spans(text: Column, kind: CharacterClass) -> Column:
    pattern = f"{kind.run}{{{kind.least},}}"

    def of(span: Column) -> Column:
        candidate = F.substring(text, span["start"] + 1, span["end"] - span["start"])

        def judged(c: Column) -> Column:
            allowed = F.lit(False)
            for entry in ALLOWED_WHOLE:
                allowed = allowed | c.rlike(entry)
            needed = F.lit(True)
            for part in kind.needs:
                needed = needed & c.rlike(part)
            high = F.transform(
                _piecewise_windows(c, kind),
                lambda w: F.struct(
                    (span["start"] + w["start"]).alias("start"),
                    F.lit(KINDS.index("entropy")).alias("kind"),
                    (span["start"] + w["end"]).alias("end"),
                ),
            )
            return F.when(needed & ~allowed, high).otherwise(_none())

        return let(candidate, judged)

    return F.flatten(F.transform(_matches(text, pattern, KINDS.index("entropy")), of))


def _patterns(text: Column) -> Column:
    return F.concat(_matches(text, ASSIGN, 0, 1, ASSIGN_LEAST), _matches(text, ACCESS, 1), _matches(text, HEX, 2))


def spans(text: Column) -> Column:
    """Struct of ``base`` and ``added`` spans ``(start, kind, end)`` in code points, each sorted.

    ``kind`` is a position in ``KINDS``. Added spans may overlap base ones and, if of different classes, each other; equal ones are listed
    once. Null counts as the empty text.
    """

    def scan(t: Column) -> Column:
        def with_added(found: Column) -> Column:
            swept = F.array_distinct(F.concat(*(_entropy_spans(t, kind) for kind in CLASSES)))
            within = lambda s: F.exists(found, lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"]))
            return F.struct(found.alias("base"), F.sort_array(F.filter(swept, lambda s: ~within(s))).alias("added"))

        return let(F.sort_array(_patterns(t)), with_added)

    return let(F.coalesce(text, F.lit("")), scan)


def to_mask(text: Column) -> Column:
    """Sorted spans ``(start, kind, end)`` of all that must not stay readable; they may overlap.

    They cover what ``spans`` lists. Null counts as the empty text.
    """

    def scan(t: Column) -> Column:
        return F.sort_array(F.concat(_patterns(t), *(_entropy_spans(t, kind) for kind in CLASSES)))

    return let(F.coalesce(text, F.lit("")), scan)


def listed(found: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    name = F.lit(list(KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")


def masked(text: Column, found: Column, mask: str = "[secret]") -> Column:
    """The text with every maximal run of overlapping spans replaced by ``mask``; null stays null."""

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(state["text"], state["at"] + 1, s["start"] - state["at"])
        return F.struct(
            state["text"].alias("text"),
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(s["start"] < state["at"], state["parts"])
            .otherwise(F.concat(state["parts"], F.array(gap, F.lit(mask))))
            .alias("parts"),
        )

    start = F.struct(text.alias("text"), F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    replaced = F.aggregate(
        found,
        start,
        step,
        lambda state: F.concat(F.array_join(state["parts"], ""), F.substring(state["text"], state["at"] + 1, F.length(state["text"]))),
    )
    return F.when(F.size(found) > 0, replaced).otherwise(text)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, base, added)`` for every row: sorted arrays of spans, empty for null and empty texts. Keys may repeat or be null."""
    return docs.select(F.col(key).alias("key"), spans(F.col(text)).alias("found")).select("key", "found.base", "found.added")
