"""DuckDB text of the harness views (FIXTURES.md part 2), used to build the
independent SQL oracles. ``with_views(sql, *names)`` prepends the CTEs a query
needs, in dependency order."""

from __future__ import annotations

LINE_KEY_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_assay": ((), """
select p.p_partkey as dms_id, p.p_partkey as file_order, p.p_name as uniprot_id,
       case when p.p_type in ('SMALL','PROMO') then 'OrganismalFitness' else p.p_type end as coarse_type,
       concat(p.p_name, ' ', p.p_brand) as phenotype, n.n as num_mutants
from part p left join (select l_partkey, count(*) as n from lineitem group by l_partkey) n
  on n.l_partkey = p.p_partkey"""),
    "v_pred": ((), f"""
select l_suppkey as dms_id, {LINE_KEY_SQL},
       l_extendedprice as dms_score, l_quantity * (1 - l_discount) as pred,
       case when l_returnflag = 'R' then 1 else 0 end as dms_score_bin
from lineitem"""),
    "v_model_pred": ((), f"""
select m.model, l.l_partkey as dms_id, p.p_type as category, l.l_extendedprice as y,
       case m.model when 'quantity' then l.l_quantity when 'discount' then l.l_discount else l.l_tax end as pred,
       l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice, l.l_quantity, l.l_shipdate
from lineitem l join part p on p.p_partkey = l.l_partkey
cross join (select 'quantity' as model union all select 'discount' union all select 'tax') m"""),
    "v_list": ((), """
select l_partkey as list_id, l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_extendedprice, l_quantity,
       l_extendedprice / cast(100000 as double) as y_true, l_quantity / cast(50 as double) as y_pred,
       case when l_linestatus = 'F' then 1 else 0 end as valid
from lineitem"""),
    "v_token": ((), """
select l_orderkey as item,
       concat(substr('ACDEFGHIKLMNPQRSTVWY', cast(l_suppkey % 20 as int) + 1, 1),
              cast(cast(l_quantity as int) as varchar),
              substr('ACDEFGHIKLMNPQRSTVWY', cast(l_partkey % 20 as int) + 1, 1)) as tok
from lineitem"""),
    "v_mutant": (("v_token",), """
select item, array_to_string(list_sort(list(tok)), ':') as mutant from v_token group by item"""),
    "v_vec": ((), """
select vec_id, label, cast(generate_subscripts(embedding, 1) - 1 as int) as idx,
       unnest(embedding)::double as v from embeddings"""),
    "v_tau": (("v_vec",), """
select c.label as property, c.idx, c.v - g.v as v
from (select label, idx, avg(v) as v from v_vec group by label, idx) c
join (select idx, avg(v) as v from v_vec group by idx) g on g.idx = c.idx"""),
    "v_lowrank": (("v_vec",), """
select cast(vec_id % 4 as int) as property, cast(floor(vec_id / 8) as int) as prefix,
       case when cast(floor(vec_id / 4) as bigint) % 2 = 0 then 'A' else 'B' end as matrix,
       cast(floor(idx / 8) as int) as r, cast(idx % 8 as int) as c, v
from v_vec"""),
    "v_trainlog": ((), """
select property, cast(row_number() over (partition by property order by d) as int) as epoch, val
from (select event_type as property, cast(date_trunc('day', ts) as date) as d, avg(value) as val
      from events group by 1, 2) q"""),
    "v_steplog": ((), """
select event_type as property, cast(date_trunc('day', ts) as date) as epoch,
       cast(row_number() over (partition by event_type, cast(date_trunc('day', ts) as date)
                               order by ts, event_id) as int) as step,
       value as loss, concat('step_', cast(event_id as varchar)) as name
from events"""),
    "v_seq": ((), "select doc_id, lang as category, source, text, n_chars from documents"),
}


def r6(expr: str) -> str:
    """SQL twin of ``round_doubles``: round(x * 1e6) / 1e6, with -0.0 folded to 0.0."""
    return f"(round(({expr}) * 1e6) / 1e6 + 0.0)"


def with_views(sql: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``sql`` with the CTEs for ``names`` (and their dependencies), then ``extra``
    (name, body) CTEs in the given order."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in VIEWS[n][0]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    ctes = [f"{n} as ({VIEWS[n][1].strip()})" for n in order]
    ctes += [f"{n} as ({body.strip()})" for n, body in (extra or [])]
    if not ctes:
        return sql.strip()
    return "with " + ",\n".join(ctes) + "\n" + sql.strip()
