"""Places of regular-expression matches as columns, without leaving the JVM.

Spark gives all matches of a pattern or the pieces between them, but no positions. The pieces and matches of one
pattern alternate, so running sums of their lengths (in code points) are the positions. ``matched`` runs both only
on texts that pass a cheap guard; ``placed`` turns the two arrays into (start, end, value, before, after) structs, end
exclusive, where before and after are the characters next to a match, up to the neighbouring match: 24 and 1.

An array of n structs is built in runs of 64, so that appending to it copies little; what the runs are cut from is bound
once for each text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,value:string,before:string,after:string>"
BEFORE = 24
#: Structs that are appended one by one.
RUN = 64


def matched(text: str, name: str, pattern: str, guard: Column, group: int | None = None) -> list[Column]:
    """Columns g_<name> (pieces), m_<name> (matches) and, for ``group``, v_<name> (what the group took); null where not guarded."""
    p = F.lit(pattern)
    out = [F.when(guard, F.split(text, pattern, -1)).alias(f"g_{name}"), F.when(guard, F.regexp_extract_all(text, p, F.lit(0))).alias(f"m_{name}")]
    return out + ([F.when(guard, F.regexp_extract_all(text, p, F.lit(group))).alias(f"v_{name}")] if group else [])


def placed(name: str, grouped: bool = False) -> Column:
    """(start, end, value, before, after) of each match; value is the match, or what the group took. Never null."""
    value = "x.v" if grouped else "x.m"
    n = f"size(m_{name})"
    zipped = f"cast(arrays_zip(slice(g_{name}, 1, {n}), m_{name}, slice(g_{name}, 2, {n}), {'v' if grouped else 'm'}_{name}) as array<struct<g:string,m:string,h:string,v:string>>)"
    none = f"cast(array() as array<{SPAN}>)"
    one = f"named_struct('start', a.pos + length(x.g), 'end', a.pos + length(x.g) + length(x.m), 'value', {value}, 'before', right(x.g, {BEFORE}), 'after', left(x.h, 1))"
    run = f"aggregate(r, named_struct('pos', 0, 'out', {none}), (a, x) -> named_struct('pos', a.pos + length(x.g) + length(x.m), 'out', concat(a.out, array({one}))))"
    cut = f"transform(sequence(1, {n}, {RUN}), i -> slice(z, i, {RUN}))"
    runs = f"transform(array({zipped}), z -> transform({cut}, r -> {run}))[0]"
    moved = "transform(r.out, s -> named_struct('start', a.pos + s.start, 'end', a.pos + s.end, 'value', s.value, 'before', s.before, 'after', s.after))"
    whole = f"aggregate({runs}, named_struct('pos', 0, 'out', cast(array() as array<array<{SPAN}>>)), (a, r) -> named_struct('pos', a.pos + r.pos, 'out', concat(a.out, array({moved}))), a -> flatten(a.out))"
    return F.expr(f"if(coalesce({n}, 0) > 0, {whole}, {none})")


def listed(spans: Column) -> Column:
    """kind:start:end of an ordered array of structs, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
