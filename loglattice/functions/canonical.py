"""Message canonicalisation: replace high-entropy tokens with typed placeholders.

A rule set is data: an ordered list of (pattern, replacement). It is applied with the JVM's own
`regexp_replace`, one lambda step per rule, so the expression stays linear in the number of rules.
Each step is guarded by a probe that is far cheaper than the rule (a byte search, or a regex
without word boundaries): every text the rule can change passes its probe, so the result is the
same and most steps cost no regex at all.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's \d \s \w \b are Unicode aware and its dot stops at \n only; (?Ud) asks Java for the same.
JAVA_FLAGS = "(?Ud)"


@dataclass(frozen=True)
class Rule:
    """`literal` and `probe` are necessary conditions for `pattern` to match."""

    name: str
    pattern: str
    replacement: str
    literal: str | None = None
    probe: str | None = None


# The v1 rules, in the order they apply.
_QUAD = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
_ISO = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"
_H = "[0-9a-fA-F]"
RULES_V1: tuple[Rule, ...] = (
    Rule("R01", rf"\bMAC=({_H}{{2}}:){{5,}}{_H}{{2}}\b", "MAC=<MAC>", "MAC="),
    Rule("R02", rf"\bSRC={_QUAD}\b", "SRC=<IPV4>", "SRC="),
    Rule("R03", rf"\bDST={_QUAD}\b", "DST=<IPV4>", "DST="),
    Rule("R04", r"\bSPT=\d+\b", "SPT=<PORT>", "SPT="),
    Rule("R05", r"\bDPT=\d+\b", "DPT=<PORT>", "DPT="),
    Rule("R06", r"\bLEN=\d+\b", "LEN=<N>", "LEN="),
    Rule("R07", r"\bID=\d+\b", "ID=<N>", "ID="),
    Rule("R08", r"\bTTL=\d+\b", "TTL=<N>", "TTL="),
    Rule("R09", r"\bts=\S+", "ts=<TS>", "ts="),
    Rule("R10", r"\bcaller=(\w+\.go):\d+", r"caller=\1:<LINE>", "caller="),
    Rule("R11", r"\bduration=\S+", "duration=<DUR>", "duration="),
    Rule("R12", r"\[BATCH\] Sending \d+", "[BATCH] Sending <N>", "[BATCH] Sending "),
    Rule("R13", r"\bfor user \S+", "for user <USER>", "for user "),
    Rule("R14", r"\((\w+)\) CMD \((.+?)\)", "(<USER>) CMD (<CMD>)", ") CMD ("),
    Rule(
        "R15",
        r"\[GIN\]\s*\d{4}/\d{2}/\d{2}\s*-\s*\d{2}:\d{2}:\d{2}\s*\|\s*(\d+)\s*\|\s*\S+\s*\|\s*\S+",
        r"[GIN] <TS> | \1 | <DUR> | <ADDR>",
        "[GIN]",
    ),
    Rule("R16", r"\b\d+(\.\d+)?(ms|s|m|h|us|µs|ns)\b", "<DUR>", None, r"\d[smhunµ]"),
    Rule("R17", r"\bsession-\d+\.scope\b", "session-<SID>.scope", "session-"),
    Rule("R18", r"\b(session|Session)\s+\d+\b", r"\1 <SID>", "ession"),
    Rule("R19", rf"\bveth{_H}+\b", "veth<HEX>", "veth"),
    Rule("R20", rf"^{_ISO}[.\d]*[Z]?\s*", "<TS> ", ":"),
    Rule("R21", r",\d{1,3}\s*-\s", " - ", ","),
    Rule("R22", r"\[\s*\d+\]", "[<PID>]", "["),
    Rule("R23", rf"{_ISO}([.\d]*)([+-]\d{{2}}:?\d{{2}}|Z)?", "<TS>", ":", r"\d-\d\d-\d\d[T ]\d"),
    Rule("R24", rf"\b{_H}{{8}}-{_H}{{4}}-{_H}{{4}}-{_H}{{4}}-{_H}{{12}}\b", "<UUID>", "-",
         rf"{_H}-{_H}{{4}}-{_H}{{4}}-{_H}{{4}}-{_H}"),
    Rule("R25", rf"\b{_H}{{16,}}\b", "<HEX>", None, rf"{_H}{{16}}"),
    Rule("R26", rf"\b{_QUAD}\b", "<IPV4>", ".", r"\d\.\d{1,3}\.\d"),
    Rule("R27", rf"\b({_H}{{2}}:){{5}}{_H}{{2}}\b", "<MAC>", ":", rf"{_H}:{_H}{{2}}:{_H}"),
    Rule("R28", rf"\b({_H}{{1,4}}:){{2,7}}{_H}{{1,4}}\b", "<IPV6>", ":", rf"{_H}:{_H}{{1,4}}:{_H}"),
    Rule("R29", r"\bpid=\d+\b", "pid=<PID>", "pid="),
    Rule("R30", r"\b\d+(\.\d+)?\s*(ms|s|m|h|us|ns|seconds|minutes|hours)\b", "<DUR>", None, r"\d\s*[smhun]"),
    Rule("R31", r"\b\d{5,}\b", "<N>", None, r"\d{5}"),
    Rule("R32", r"  +", " ", "  "),
)

# The characters stripped from both ends (Unicode white space and the ASCII separators).
STRIP_CHARS = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)]
        + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)

VERSIONS: dict[str, tuple[Rule, ...]] = {"v1": RULES_V1}
DEFAULT_VERSION = "v1"


def register_version(name: str, rules: Sequence[Rule]) -> None:
    """Add a rule set; published versions are immutable so old templates can be recomputed."""
    if name in VERSIONS:
        raise ValueError(f"canonicalisation version {name!r} already exists")
    VERSIONS[name] = tuple(rules)


def rules_for(version: str) -> tuple[Rule, ...]:
    try:
        return VERSIONS[version]
    except KeyError:
        raise ValueError(f"unknown canonicalisation version {version!r}") from None


def java_replacement(replacement: str) -> str:
    r"""`\1` back-references become Java's `$1`."""
    out, i = [], 0
    while i < len(replacement):
        ch = replacement[i]
        if ch == "\\" and i + 1 < len(replacement) and replacement[i + 1].isdigit():
            out.append("$" + replacement[i + 1])
            i += 2
            continue
        out.append("\\" + ch if ch in "$\\" else ch)
        i += 1
    return "".join(out)


def sql_literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def rule_sql(rule: Rule, text: str = "t") -> str:
    """One guarded replacement of the SQL name `text`."""
    replaced = (
        f"regexp_replace({text}, {sql_literal(JAVA_FLAGS + rule.pattern)}, "
        f"{sql_literal(java_replacement(rule.replacement))})"
    )
    guards = []
    if rule.literal is not None:
        guards.append(f"contains({text}, {sql_literal(rule.literal)})")
    if rule.probe is not None:
        guards.append(f"{text} RLIKE {sql_literal(JAVA_FLAGS + rule.probe)}")
    return f"CASE WHEN {' AND '.join(guards)} THEN {replaced} ELSE {text} END" if guards else replaced


@cache
def _chain_sql(rules: tuple[Rule, ...]) -> str:
    chain = "array(m)"
    for rule in rules:
        chain = f"transform({chain}, t -> {rule_sql(rule)})"
    return f"m -> btrim(get({chain}, 0), {sql_literal(STRIP_CHARS)})"


def apply_to_each(texts: Column, function_sql: str) -> Column:
    """transform() with the lambda given as SQL: one call to the JVM, however long the lambda."""
    return F.call_function("transform", texts, F.expr(function_sql))


def bind(value: Column, function_sql: str) -> Column:
    """Evaluate a SQL lambda on one value, computed once however often the lambda uses it."""
    return F.get(apply_to_each(F.array(value), function_sql), F.lit(0))


def canonicalize(text: Column, version: str = DEFAULT_VERSION) -> Column:
    """Canonical form of a message; null stays null."""
    return bind(text, _chain_sql(rules_for(version)))


def canon_hash(canonical: Column, service: Column, level: Column) -> Column:
    """Template identity: 32 hex digits over service, level and canonical text."""
    sep = F.lit("|")
    return F.substring(F.sha2(F.concat(service, sep, level, sep, canonical), 256), 1, 32)


def text_hash(canonical: Column) -> Column:
    """32 hex digits over the canonical text alone, shared by equal texts of different services."""
    return F.substring(F.sha2(canonical, 256), 1, 32)


def template_key(message: Column, service: Column, level: Column, version: str = DEFAULT_VERSION) -> Column:
    """Struct of canonical text, template hash and rule version."""
    keyed = F.transform(
        F.array(canonicalize(message, version)),
        lambda c: F.struct(
            c.alias("canonical_text"),
            canon_hash(c, service, level).alias("template_hash"),
            F.lit(version).alias("canon_version"),
        ),
    )
    return F.get(keyed, F.lit(0))
