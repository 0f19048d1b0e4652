"""DuckDB SQL snippets for the text oracles, written from the same fixed word
lists (the lists are data; the SQL is an independent formulation)."""
from __future__ import annotations

from eventlens import lexicons as L


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def hits(expr: str, terms) -> str:
    return "(" + " + ".join(f"CAST(contains({expr}, {q(t)}) AS INTEGER)" for t in terms) + ")"


def inlist(terms) -> str:
    return "(" + ", ".join(q(t) for t in terms) + ")"


TEXT = "coalesce(title, '') || chr(10) || coalesce(content, '')"
SQUEEZE = "trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
WORDB = "(^|[^\\p{{L}}\\p{{N}}_]){a}([^\\p{{L}}\\p{{N}}_]|$)"


def squeeze(x: str) -> str:
    return SQUEEZE.format(x=x)


def best_group(low: str, groups) -> str:
    """Name of the first group with the most hits, or NULL when none hit."""
    arms = []
    n = len(groups)
    h = [hits(low, kws) for _, kws in groups]
    for i, (name, _) in enumerate(groups):
        conds = [f"{h[i]} > 0"]
        conds += [f"{h[i]} > {h[j]}" for j in range(i)]
        conds += [f"{h[i]} >= {h[j]}" for j in range(i + 1, n)]
        arms.append(f"WHEN {' AND '.join(conds)} THEN {q(name)}")
    return "CASE " + " ".join(arms) + " END"


def best_hits(low: str, groups) -> str:
    return "greatest(" + ", ".join(hits(low, kws) for _, kws in groups) + ")"


def word_pos(low: str, alias: str) -> str:
    """1-based start of the alias as a whole word, 0 when absent."""
    import re
    pat = WORDB.format(a=re.escape(alias).replace("'", "''"))
    m = f"regexp_extract({low}, '{pat}', 0)"
    lead = f"regexp_extract({low}, '{pat}', 1)"
    return (f"CASE WHEN regexp_matches({low}, '{pat}') THEN "
            f"strpos({low}, {m}) + length({lead}) ELSE 0 END")


def alias_pos(low: str, alias: str, short: bool) -> str:
    return word_pos(low, alias) if short else f"strpos({low}, {q(alias)})"
