"""Chat formatting by a grammar round trip, with DataFrame functions alone.

**Template.** Every turn stands between two marks of its role, ``[INST]`` text ``[/INST]``; a role without marks of its own is named:
``[ROLE]`` role ``[SAYS]`` text ``[/ROLE]``. A conversation is its turns one after another.

**Parser.** Deterministic and linear: the text is cut before every mark, each piece is a mark and what follows it, and the kinds of
marks must spell pairs, with nothing behind a closing one. Marks begin with one of few characters and none overlaps another, so there is one
way to cut. In what a turn says, an escaped mark (``[\\INST]``: a backslash after the first character) loses one backslash.

**Round trip.** A turn is rendered as it is, reparsed, and compared with its source. Where they differ its plain marks are escaped and
it is reparsed; where they still differ, as in a text that holds escaped marks itself, all of them get one backslash more,
which is always undone exactly. Most turns differ from nothing and stay as they are. Then each whole conversation is parsed again and
held against its turns: ``identical``.

The loss mask is a list of (start, length) in code points of the formatted text: what the turns of ``loss_roles`` say, without marks.

Turns are rendered before anything moves; each conversation meets once, its offsets a running sum. A formatted conversation is one value, so
its turns meet in one row: that is the result's own size, and the only bound. A conversation of 30,000 turns is one row as well.

Null role or text: empty. Null turn: before all others. Equal turns: by role, then text. Repeated rows: each is a turn. Null id: a
conversation like any other. Empty text: a turn that says nothing; empty table: no rows. Very long texts: whole. Extra columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks by role, the three marks of roles that have none, and the roles a model is trained on."""

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    other: tuple[str, str, str] = ("[ROLE]", "[SAYS]", "[/ROLE]")
    loss_roles: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        marks = self.controls
        if len(set(marks)) < len(marks) or any(len(m) < 3 or m[0].isalnum() or m[0] in "\\ \n" or m[1] == "\\" for m in marks):
            raise ValueError("marks are different, have three characters or more and begin with a sign")
        for a in marks:
            for b in marks:
                if any(a.endswith(b[:n]) for n in range(1, len(b) + 1) if a != b or n < len(b)) or (a != b and a in b):
                    raise ValueError(f"{a} and {b} overlap")

    @property
    def controls(self) -> list[str]:
        return [m for pair in self.marks.values() for m in pair] + list(self.other)

    @property
    def any_control(self) -> str:
        return "|".join(re.escape(m) for m in sorted(self.controls, key=len, reverse=True))

    @property
    def before_control(self) -> str:
        """Pattern of the places before marks. Most characters begin none, which one look at a class of characters tells."""
        firsts = "".join(re.escape(c) for c in sorted({m[0] for m in self.controls}))
        return f"(?=[{firsts}])(?={self.any_control})"

    def escaped(self, slashes: str) -> str:
        """Pattern of all marks with ``slashes`` behind their first character: that one and the rest are two groups of each."""
        return "|".join(f"({re.escape(m[0])})({slashes}{re.escape(m[1:])})" for m in self.controls)


DEFAULT = Template()


def _escape(text: Column, template: Template, slashes: str) -> Column:
    n = len(template.controls)
    put = "".join(f"${2 * k + 1}" for k in range(n)) + "\\\\" + "".join(f"${2 * k + 2}" for k in range(n))
    return F.regexp_replace(text, template.escaped(slashes), put)


def unescape(text: Column, template: Template = DEFAULT) -> Column:
    """One backslash less in each escaped mark."""
    pattern = "|".join(f"(?<={re.escape(m[0])})\\\\(?=\\\\*{re.escape(m[1:])})" for m in template.controls)
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, pattern, "")).otherwise(text)


def render(role: Column, text: Column, template: Template = DEFAULT, name: Column | None = None) -> Column:
    """One turn between its marks; ``name``: the role as it is written, if it has no marks."""
    one, two, three = template.other
    out = F.when(F.lit(False), F.lit(""))
    for known, (a, b) in template.marks.items():
        out = out.when(role == known, F.concat(F.lit(a), text, F.lit(b)))
    return out.otherwise(F.concat(F.lit(one), role if name is None else name, F.lit(two), text, F.lit(three)))


def parse(formatted: Column, template: Template = DEFAULT) -> Column:
    """The turns of a formatted text, as an array of (role, text); null where it is not well formed."""
    kinds = {m: chr(ord("a") + k) for k, m in enumerate(template.controls)}
    control = template.any_control
    kind = lambda mark: F.coalesce(*[F.when(mark == m, F.lit(k)) for m, k in kinds.items()], F.lit("-"))
    pieces = F.transform(F.split(formatted, template.before_control), lambda p: F.struct(F.regexp_extract(p, f"^(?:{control})", 0).alias("mark"), p.alias("all")))
    pieces = F.transform(pieces, lambda p: F.struct(kind(p["mark"]).alias("kind"), F.substring(p["all"], F.length(p["mark"]) + 1, F.length(p["all"])).alias("says")))
    one, two, three = (kinds[m] for m in template.other)
    pairs = "|".join([kinds[a] + kinds[b] for a, b in template.marks.values()] + [one + two + three])
    closing = [kinds[b] for _, b in template.marks.values()] + [three]
    spelled = F.array_join(F.transform(pieces, lambda p: F.when(p["kind"].isin(closing) & (p["says"] != ""), F.lit("-")).otherwise(p["kind"])), "")
    opening = {kinds[a]: r for r, (a, _) in template.marks.items()}

    def turn(p: Column, i: Column) -> Column:
        named = F.lit(None).cast("string")
        for k, r in opening.items():
            named = F.when(p["kind"] == k, F.lit(r)).otherwise(named)
        named = F.when(p["kind"] == two, unescape(F.get(pieces, i - 1)["says"], template)).otherwise(named)
        return F.struct(named.alias("role"), unescape(p["says"], template).alias("text"))

    turns = F.filter(F.transform(pieces, turn), lambda t: t["role"].isNotNull())
    return F.when(formatted == "", F.array().cast("array<struct<role:string,text:string>>")).when(F.regexp_replace(spelled, pairs, "") == "", turns)


def render_until_identical(role: Column, text: Column, template: Template = DEFAULT) -> Column:
    """Struct (shown, rounds): the turn with as much escaped as it takes until its reparse is its source."""
    want = F.array(F.struct(role.alias("role"), text.alias("text")))
    escape = lambda x, slashes: _escape(x, template, slashes)
    tries = [render(role, text, template)] + [render(role, escape(text, s), template, escape(role, s)) for s in ("", r"\\*")]
    out = F.struct(tries[2].alias("shown"), F.lit(2).alias("rounds"))
    for k in (1, 0):
        out = F.when(parse(tries[k], template).eqNullSafe(want), F.struct(tries[k].alias("shown"), F.lit(k).alias("rounds"))).otherwise(out)
    return out


def format_conversations(rows: DataFrame, template: Template = DEFAULT, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, loss, rounds, identical) of each conversation; ``loss``: spans of the formatted text."""
    empty = lambda c: F.coalesce(rows[c].cast("string"), F.lit(""))
    turns = rows.select(rows[id_col].cast("long").alias("conv_id"), rows[turn_col].cast("long").alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text"))
    turns = turns.withColumn("r", render_until_identical(F.col("role"), F.col("text"), template))
    # The text under the mask, as it is written: behind the mark that opens it, before the one that closes it.
    first, last = F.lit(0), F.lit(0)
    for known, (a, b) in template.marks.items():
        first, last = F.when(F.col("role") == known, len(a)).otherwise(first), F.when(F.col("role") == known, len(b)).otherwise(last)
    shown = F.length("r.shown").cast("long")
    # Where each turn starts: a running sum, which lets rows pass; the exchange serves the grouping too.
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum(shown).over(before), F.lit(0)))
    span = F.struct((F.col("start") + first).alias("start"), (shown - first - last).alias("length"))
    met = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "start", F.col("r.shown").alias("shown"), F.col("r.rounds").alias("rounds"), span.alias("span")))).alias("t"))
    met = met.withColumns({"formatted": F.array_join(F.transform("t", lambda x: x["shown"]), ""), "rounds": F.array_max(F.transform("t", lambda x: x["rounds"]))})
    spans = F.transform(F.filter("t", lambda x: x["role"].isin(list(template.loss_roles))), lambda x: x["span"])
    same = parse(F.col("formatted"), template).eqNullSafe(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))))
    return met.select("conv_id", "formatted", spans.alias("loss"), "rounds", same.alias("identical"))


def read_back(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """(conv_id, turns, loss_text) from ``formatted`` and ``loss`` alone, and the other columns as they are."""
    under = F.transform("loss", lambda s: unescape(F.substring("formatted", s["start"].cast("int") + 1, s["length"].cast("int")), template))
    return formatted.withColumns({"turns": parse(F.col("formatted"), template), "loss_text": F.array_join(under, "")})
