"""Forward chaining: positive rules that add facts until nothing new follows."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.codec import Id, constant_key
from factloom.operators.paths import PathIndex
from factloom.operators.shared import cut, distinct
from factloom.plans.algebra import And, Constraint, Pattern, Var, Where, rows
from factloom.plans.paths import step
from factloom.sources.facts import COLUMNS, FactSource, UnionSource
from factloom.streaming.delta import pattern_changes


@dataclass(frozen=True)
class New:
    """An entity that a rule makes: its id follows from the rule's name, this name and the values of all variables, so
    one binding makes one entity however often it is found."""

    name: str


@dataclass(frozen=True)
class Rule:
    """``when``: clauses (e, a, v); ``then``: facts to add, of variables, constants and New; ``where``: other
    constraints, made for the query."""

    name: str
    when: tuple[tuple, ...]
    then: tuple[tuple, ...]
    where: tuple[Constraint, ...] = field(default=())

    def __post_init__(self) -> None:
        bound = {t.name for c in self.when for t in c if isinstance(t, Var)}
        free = {t.name for c in self.then for t in c if isinstance(t, Var)} - bound
        if free:
            raise ValueError(f"rule {self.name}: {sorted(free)} are bound by nothing")


def string_contains(container: Var, needle: Var) -> Where:
    """Both are texts and the first holds the second, by code points."""
    def test(c: dict[str, Column]) -> Column:
        a, b = c[container.name], c[needle.name]
        return a.startswith("=t:") & b.startswith("=t:") & F.contains(F.substring(a, 4, 2147483647), F.substring(b, 4, 2147483647))
    return Where(test, (container, needle))


def _column(rule: Rule, term: object, names: list[str], value: bool) -> Column:
    if isinstance(term, Var):
        return F.col(term.name)
    if isinstance(term, New):
        parts = [F.lit(rule.name), F.lit(term.name), *(F.col(n) for n in sorted(names))]
        return F.substring(F.sha2(F.concat(*[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]), 256), 33, 32)
    return F.lit(constant_key(term) if value and not isinstance(term, Id) else term.value if isinstance(term, Id) else str(term))


def fire(rule: Rule, full: FactSource, delta: FactSource | None, about: int = 0) -> DataFrame:
    """Facts that follow from bindings with a new fact; from all bindings if ``delta`` is None. ``about``: how many, if
    known."""
    clauses = [Pattern(full, *c) for c in rule.when]
    found = rows(And(*clauses, *rule.where)) if delta is None else rows(pattern_changes(clauses, full, delta, *rule.where))
    names = found.columns
    made = F.array(*[F.struct(_column(rule, e, names, False).alias("e"), _column(rule, a, names, False).alias("a"), _column(rule, v, names, True).alias("v")) for e, a, v in rule.then])
    out = found.select(F.explode(made).alias("f")).select("f.*")
    return distinct(_typed(out), about, "e", "a", "v")


def _typed(facts: DataFrame) -> DataFrame:
    """Facts (e, a, v) with the typed columns of their values."""
    whole = F.when(F.col("v").startswith("=i:") | F.col("v").startswith("=d:"), F.substring("v", 4, 30).try_cast("bigint"))
    number = F.when(F.col("v").rlike("^=[ifn]:"), F.substring("v", 4, 60).try_cast("double"))
    return facts.select("e", "a", "v", whole.alias("int"), number.alias("num"))


@dataclass(frozen=True)
class Advanced:
    """facts: all of them; rounds run; quiescent: whether nothing more follows."""

    facts: DataFrame
    rounds: int
    quiescent: bool


def advance(facts: DataFrame, rules: list[Rule], budget: int | None = None, delta: DataFrame | None = None) -> Advanced:
    """Applies the rules, semi-naively, until quiescent or for ``budget`` rounds. With ``delta`` (new facts among
    ``facts``) only what follows from these is sought in the first round too.

    Without a budget and delta, where  x B y => x A y  and  x A y, y B z => x A z  are rules and no rule makes B, the
    closure of B is found first, by doubling, as facts of A: it follows from these rules, and they needn't find it link
    by link. So the rounds are few however long the chains are."""
    if budget is None and delta is None:
        for a, b in chains(rules):
            pairs = PathIndex.build(FactSource(facts), step(b).plus()).pairs
            facts = facts.select(*COLUMNS).unionByName(_typed(pairs.select(F.col("src").alias("e"), F.lit(a).alias("a"), F.col("dst").alias("v"))))
    return _advance(facts, rules, budget, delta)


def chains(rules: list[Rule]) -> list[tuple[str, str]]:
    """The (A, B) for which the rules say that A is the closure of B, among ids."""
    heads_ = [a for r in rules for _, a, _ in r.then]
    if any(isinstance(a, (Var, New)) for a in heads_):
        return []

    def plain(*terms: object) -> bool:
        return not any(isinstance(t, (Var, New)) for t in terms)

    bases, steps = set(), set()
    for r in rules:
        if len(r.then) != 1 or r.where:
            continue
        if len(r.when) == 1:
            (x, b, y), (x2, a, y2) = r.when[0], r.then[0]
            if isinstance(x, Var) and isinstance(y, Var) and x != y and (x, y) == (x2, y2) and plain(a, b):
                bases.add((str(a), str(b)))
        elif len(r.when) == 2:
            for (x, a, y), (y2, b, z) in (r.when, r.when[::-1]):
                if all(isinstance(t, Var) for t in (x, y, z)) and y == y2 and len({x, y, z}) == 3 and r.then[0] == (x, a, z) and plain(a, b) and str(a) != str(b):
                    steps.add((str(a), str(b)))
    return sorted(c for c in bases & steps if c[1] not in {str(a) for a in heads_})


def _advance(facts: DataFrame, rules: list[Rule], budget: int | None, delta: DataFrame | None) -> Advanced:
    rows = facts.count()
    held = cut(distinct(facts.select(*COLUMNS), rows, "e", "a", "v"), rows)
    fresh = None if delta is None else cut(delta.select(*COLUMNS))
    done = 0
    while budget is None or done < budget:
        full, new = FactSource(held), None if fresh is None else FactSource(fresh)
        out = None
        for r in rules:
            part = fire(r, full, new, rows)
            out = part if out is None else out.unionByName(part)
        if out is None:
            return Advanced(held, done, True)
        fresh = cut(out.dropDuplicates(["e", "a", "v"]).join(held.select("e", "a", "v"), ["e", "a", "v"], "left_anti").select(*COLUMNS), rows)
        done += 1
        found = fresh.count()
        if not found:
            return Advanced(held, done, True)
        rows += found
        held = UnionSource(held, fresh)._df
        if done % 4 == 0:
            held = cut(held)
    return Advanced(held, done, False)


def heads(revisions: FactSource, observes: str) -> DataFrame:
    """Rule revisions (column ``state``) that no other revision replaces."""
    edges = revisions.scan(observes)
    return edges.select(F.col("e").alias("state")).distinct().join(edges.select(F.col("v").alias("state")), "state", "left_anti")


# Text format: one rule a paragraph,  name: e a v, e a v => e a v, ...  Terms: ?x a variable, *x a new entity, "text",
# numbers, true and false, anything else an id or an attribute.

_TERM = re.compile(r'"((?:[^"\\]|\\.)*)"|(\S+)')


def _term(m: re.Match, position: int) -> object:
    if m[1] is not None:
        return re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), m[1])
    word = m[2]
    if word.startswith("?"):
        return Var(word[1:])
    if word.startswith("*"):
        return New(word[1:])
    if position == 2:
        if re.fullmatch(r"[+-]?\d+", word):
            return int(word)
        if re.fullmatch(r"[+-]?\d*\.\d+([eE][+-]?\d+)?", word):
            return float(word)
        if word in ("true", "false"):
            return word == "true"
    return Id(word) if position != 1 else word


def _clauses(text: str) -> tuple[tuple, ...]:
    out, terms, outside = [], [], re.sub(r'"(?:[^"\\]|\\.)*"|,', lambda m: " \0 " if m[0] == "," else m[0], text)
    for m in [*_TERM.finditer(outside), None]:
        if m is None or m[2] == "\0":
            if terms:
                if len(terms) != 3:
                    raise ValueError(f"a clause has three terms: {text!r}")
                out.append(tuple(terms))
            terms = []
        else:
            terms.append(_term(m, len(terms)))
    return tuple(out)


def parse(text: str) -> list[Rule]:
    rules = []
    for block in re.split(r"\n\s*\n", text.strip()):
        name, colon, body = block.partition(":")
        left, arrow, right = body.partition("=>")
        if not colon or not arrow or not name.strip() or re.search(r"\s", name.strip()):
            raise ValueError(f"a rule is written  name: clauses => facts  : {block!r}")
        rules.append(Rule(name.strip(), _clauses(left), _clauses(right)))
    return rules


def write(rules: list[Rule]) -> str:
    def term(t: object) -> str:
        if isinstance(t, Var):
            return f"?{t.name}"
        if isinstance(t, New):
            return f"*{t.name}"
        if isinstance(t, Id):
            return t.value
        if isinstance(t, bool):
            return str(t).lower()
        return str(t) if not isinstance(t, str) else t

    def clause(c: tuple) -> str:
        last = c[2]
        if isinstance(last, str):
            last = '"' + last.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t") + '"'
        return f"{term(c[0])} {term(c[1])} {last if isinstance(last, str) else term(last)}"

    return "\n\n".join(f"{r.name}: {', '.join(map(clause, r.when))} => {', '.join(map(clause, r.then))}" for r in rules) + "\n"
