"""DuckDB SQL of the registered queries."""

from __future__ import annotations

_TOK = """raw as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f]+'), lambda x: x <> '') r from documents),
tok as (select doc_id, list_filter(list_transform(r, lambda x: regexp_replace(x, '^[^a-z]+|[^a-z]+$', '', 'g')), lambda x: x <> '') w from raw),
words as (select doc_id, unnest(w) word from tok),
cleaned as (select doc_id, list_transform(r, lambda x: regexp_replace(x, '^[^a-z]+|[^a-z]+$', '', 'g')) c from raw)"""

_PAIRS = """wc as (select word, count(*) n from fw group by 1 having count(*) >= 10),
pairs as (select a.word x, b.word y, count(*) n from fw a join fw b using (doc_id) where a.word <> b.word and a.word in (select word from wc) and b.word in (select word from wc) group by 1, 2 having count(*) >= 10),
pmi as (select x, y, pairs.n, round(log10(pairs.n * cast((select count(*) from documents) as double) / (a.n * b.n)), 6) pmi from pairs join wc a on a.word = x join wc b on b.word = y)"""

_PMI = f"""{_TOK},
firsts as (select doc_id, list_distinct(list_concat(list_filter(c[1:99], lambda x: x <> ''), list_filter(c[100:], lambda x: x <> '')[1:1])) w from cleaned),
fw as (select doc_id, unnest(w) word from firsts),
{_PAIRS}"""

#: The same of whole texts.
_PMI_WHOLE = f"""{_TOK},
fw as (select doc_id, unnest(list_distinct(w)) word from tok),
{_PAIRS}"""

_BI = f"""{_TOK},
bi as (select w[i] a, w[i + 1] b, count(*) n from (select w, unnest(range(1, len(w))) i from tok where len(w) >= 2) group by 1, 2)"""

_IDX = f"""{_TOK}, idx as (select word term, doc_id, count(*) tf from words group by 1, 2)"""

_SNIP = "case when length(split_part(text, chr(10), 1)) > 80 then substr(split_part(text, chr(10), 1), 1, 80) || '...' else split_part(text, chr(10), 1) end snippet"

_PS = """edges as (select distinct l_partkey * 2 src, l_suppkey * 2 + 1 dst from lineitem),
nodes as (select p_partkey * 2 id from part union all select s_suppkey * 2 + 1 from supplier)"""

_NAT = """edges as (select distinct s_nationkey::bigint src, c_nationkey::bigint dst from lineitem join supplier on l_suppkey = s_suppkey join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
  where (s_nationkey * 7 + c_nationkey * 3) % 5 = 0 and s_nationkey % 4 <> 3),
nodes as (select n_nationkey::bigint id from nation)"""


_PUR = """lines as (select o_custkey * 2 c, l_partkey * 2 + 1 p, bool_or(l_returnflag = 'R' and l_quantity > 45) back from lineitem join orders on l_orderkey = o_orderkey group by 1, 2),
edges as (select c src, p dst from lines union all select p, c from lines where back),
nodes as (select c_custkey * 2 id from customer union all select p_partkey * 2 + 1 from part where p_size < 45)"""


def _rank_ctes(k: int) -> str:
    out = ", deg as (select src, count(*) d from edges group by 1), r0 as (select id, 1.0::double / (select count(*) from nodes) rank from nodes)"
    for i in range(1, k + 1):
        out += f""",
i{i} as materialized (select id, coalesce(inc, 0) inc from nodes left join (select dst, sum(rank / d) inc from edges join deg using (src) join r{i - 1} on id = src group by 1) on dst = id),
m{i} as materialized (select greatest(0, 1 - sum(inc)) miss from i{i}),
r{i} as materialized (select id, 0.15::double / (select count(*) from nodes) + 0.85::double * (inc + miss / (select count(*) from nodes)) rank from i{i}, m{i})"""
    return out


def _ppr_ctes(k: int, sources: list[int]) -> str:
    out = f", deg as (select src, count(*) d from edges group by 1), s as (select unnest({sources})::bigint source), r0 as (select source, id, case when source = id then 1.0::double else 0 end rank from nodes, s)"
    for i in range(1, k + 1):
        out += f""",
c{i} as (select source, dst, sum(rank / d) inc from edges join deg using (src) join r{i - 1} on id = src group by 1, 2),
i{i} as materialized (select r0.source, id, coalesce(inc, 0) inc from r0 left join c{i} on dst = id and c{i}.source = r0.source),
m{i} as materialized (select source, greatest(0, 1 - sum(inc)) miss from i{i} group by 1),
r{i} as materialized (select source, id, case when source = id then 0.15::double + 0.85::double * (inc + miss) else 0.85::double * inc end rank from i{i} join m{i} using (source))"""
    return out


_SPAM = f"""{_TOK},
inst as (select doc_id, case when quality = 0 then 'spam' else 'ham' end label, list_transform(w, lambda x: ('0x' || substr(md5(x), 1, 5))::int) f from tok join labels using (doc_id)),
feats as (select doc_id, unnest(f) feature from inst),
vocab as (select distinct feature from feats where feature % 3 <> 0),
models as (select m model_id, feature, ((('0x' || substr(md5(m::varchar || ':' || feature::varchar), 1, 4))::int % 2001) - 1000) / 1000.0::double weight from vocab, (select unnest([1, 2, 3]) m)),
scores as (select model_id, doc_id, sum(weight) score from feats join models using (feature) group by 1, 2)"""

_APPLY = "select doc_id, label, round(coalesce(score, 0), 6) score, case when round(coalesce(score, 0), 6) > 0 then 'spam' else 'ham' end class from inst left join (select * from scores where model_id = 1) using (doc_id)"

_TERM_DOCS = "select doc_id from idx where term = '{}'"


def _date(column: str, lo: str, hi: str) -> str:
    return f"{column} >= timestamp '{lo}' and {column} < timestamp '{hi}'"


_NOV, _YEAR, _DAY = (_date("l_shipdate", a, b) for a, b in (("1996-11-01", "1996-12-01"), ("1996-01-01", "1997-01-01"), ("1996-11-01", "1996-11-02")))
_Q6 = """select l_returnflag, l_linestatus, round(sum(l_quantity), 2) sum_qty, round(sum(l_extendedprice), 2) sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 4) sum_disc_price,
round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 6) sum_charge, round(avg(l_quantity), 6) avg_qty, round(avg(l_extendedprice), 6) avg_price, round(avg(l_discount), 6) avg_disc, count(*) count_order
from lineitem where {} group by 1, 2"""

SQL: dict[str, str] = {
    "word_count": f"with {_TOK} select word, count(*) n from words group by 1",
    "prefix_count": f"with {_TOK} select substr(word, 1, 2) prefix, count(*) n from words where length(word) >= 2 group by 1",
    "line_count": "select count(*) n from documents",
    "word_lookup": f"with {_TOK} select word, count(*) n from words where word = 'the' group by 1",
    "pmi_pairs": f"with {_PMI_WHOLE} select x, y, n, pmi from pmi",
    "pmi_stripes": f"with {_PMI_WHOLE} select x, count(*) n_successors, cast(sum(n) as bigint) total, max(pmi) max_pmi from pmi group by 1",
    "pmi_top_for_word": f"with {_PMI} select y, pmi from pmi where x = 'the' order by pmi desc, y limit 10",
    "bigram_relfreq_pairs": f"with {_BI} select a, b, n, round(n / sum(n) over (partition by a), 8) freq from bi",
    "bigram_marginals": f"with {_BI} select a, cast(sum(n) as bigint) n from bi group by 1",
    "bigram_relfreq_stripes": f"with {_BI} select a, count(*) n_successors, cast(sum(n) as bigint) total, round(max(n) / sum(n), 8) max_freq from bi group by 1",
    "inverted_index": f"with {_IDX} select term, doc_id // 65536 block, count(*) df, min(doc_id) first_doc, max(doc_id) last_doc, cast(sum(tf) as bigint) sum_tf, string_agg(doc_id || ':' || tf, ',' order by doc_id) postings from idx group by 1, 2",
    "inverted_index_long": f"with {_IDX} select term, doc_id, tf from idx",
    "inverted_index_gaps": f"with {_IDX} select term, doc_id, doc_id - lag(doc_id, 1, 0) over (partition by term order by doc_id) gap, tf from idx",
    "index_decode": f"with {_IDX} select term, doc_id, tf from idx",
    "bool_and": f"with {_IDX} select doc_id, {_SNIP} from documents where doc_id in ({_TERM_DOCS.format('the')}) and doc_id in ({_TERM_DOCS.format('shor')})",
    "bool_or": f"with {_IDX} select doc_id, {_SNIP} from documents where doc_id in ({_TERM_DOCS.format('und')}) or doc_id in ({_TERM_DOCS.format('que')})",
    "bool_rpn": f"with {_IDX} select doc_id, {_SNIP} from documents where (doc_id in ({_TERM_DOCS.format('the')}) and doc_id in ({_TERM_DOCS.format('of')})) or (doc_id in ({_TERM_DOCS.format('de')}) and doc_id in ({_TERM_DOCS.format('la')})) or doc_id in ({_TERM_DOCS.format('nosuchterm')})",
    "q1": f"select count(*) cnt from lineitem where {_DAY}",
    "q1_prefix_month": f"select count(*) cnt from lineitem where {_NOV}",
    "q1_prefix_year": f"select count(*) cnt from lineitem where {_YEAR}",
    "q2": f"select o_orderpriority, o_orderkey from lineitem join orders on l_orderkey = o_orderkey where {_NOV} order by o_orderkey, o_orderpriority limit 20",
    "q3": f"select l_orderkey, p_name, s_name from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey where {_NOV} order by 1, 2, 3 limit 20",
    "q4": f"select n_nationkey, n_name, count(*) cnt from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where {_NOV} group by 1, 2 order by 1",
    "q5": "select strftime(m, '%m-%Y') \"month\", us, ca from (select date_trunc('month', l_shipdate) m, count(case when c_nationkey = 24 then 1 end) us, count(case when c_nationkey = 3 then 1 end) ca from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey where c_nationkey in (3, 24) group by 1) where us > 0 and ca > 0 order by m",
    "q6": _Q6.format(_NOV),
    "q6_prefix_year": _Q6.format(_YEAR),
    "q7": "select c_name, l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) revenue, cast(o_orderdate as date) o_orderdate, o_orderpriority from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey where o_orderdate < timestamp '1996-01-01' and l_shipdate > timestamp '1996-01-01' group by 1, 2, 4, 5 order by revenue desc, l_orderkey limit 10",
    "graph_build": f"with {_PS} select id, coalesce(n, 0) out_degree, coalesce(lo, -1) first_neighbour, coalesce(hi, -1) last_neighbour from nodes left join (select src, count(*) n, min(dst) lo, max(dst) hi from edges group by 1) on src = id",
    "graph_stats": f"with {_PS} select (select count(*) from nodes) n_nodes, count(*) n_edges, count(distinct src) n_active, count(*) filter (dst not in (select id from nodes)) n_missing from edges",
    "pagerank": f"with {_PS}{_rank_ctes(3)} select id, round(rank, 8) rank from r3",
    "pagerank_top": f"with {_PS}{_rank_ctes(3)} select id, round(rank, 8) rank from r3 order by rank desc, id limit 20",
    "pagerank_dump": f"with {_NAT}{_rank_ctes(3)}, near as (select src, list(dst order by dst)[1:10] adj from edges group by 1) select printf('{{%d %.4f [%s]}}', id, rank, coalesce(array_to_string(adj, ', '), '')) line from r3 left join near on src = id",
    "ppr_multi": f"with {_NAT}{_ppr_ctes(4, [0, 5, 12])} select source, id, round(rank, 8) rank from r4",
    "ppr_top": f"with {_NAT}{_ppr_ctes(4, [0, 5, 12])} select source, id, rank from (select source, id, round(rank, 8) rank, row_number() over (partition by source order by round(rank, 8) desc, id) p from r4) where p <= 5",
    "graph_partition_range": "select floor(n_nationkey * 10 / (select count(*)::double from nation))::bigint % 10 bucket, count(*) n from nation group by 1",
    "graph_wcc": f"with recursive {_NAT}, u as (select src a, dst b from edges union select dst, src from edges), reach as (select id, id other from nodes union select r.id, u.b from reach r join u on u.a = r.other) select count(distinct root) n_components, (select count(*) from edges) n_edges, count(*) n_nodes from (select id, min(other) root from reach group by 1)",
    "spam_apply": f"with {_SPAM} {_APPLY}",
    "spam_ensemble_avg": f"with {_SPAM} select doc_id, label, s score, case when s > 0 then 'spam' else 'ham' end class from (select doc_id, label, round(coalesce(t, 0) / 3, 6) s from inst left join (select doc_id, sum(score) t from scores group by 1) using (doc_id))",
    "spam_ensemble_vote": f"with {_SPAM} select doc_id, label, s score, case when s > 0 then 'spam' else 'ham' end class from (select doc_id, label, cast(2 * coalesce(t, 0) - 3 as double) s from inst left join (select doc_id, sum(case when round(score, 9) > 0 then 1 else 0 end) t from scores group by 1) using (doc_id))",
    "spam_auc": f"with {_SPAM}, a as ({_APPLY}) select round(100 * (1 - sum(case when p.score > n.score then 1.0 when p.score = n.score then 0.5 else 0 end)::double / count(*)), 6) one_minus_auc_pct from (select score from a where label = 'spam') p, (select score from a where label = 'ham') n",
}

_PUR_SOURCES = [0, 2, 4, 1, 7, 40]
_MESSAGES = """select '{0}' strategy, (select count(distinct dst) from placed join nodes on dst = id where part = dest) inside,
  (select count(*) from (select distinct part, dst from placed join nodes on dst = id where part <> dest)) shuffled"""
_WIDTH = "((select max(id) - min(id) from nodes) // 8 + 1)"


def _placed(strategy: str) -> str:
    at = {"modulo": "({0} % 8)", "range": f"greatest(least(({{0}} - (select min(id) from nodes)) // {_WIDTH}, 7), 0)"}[strategy]
    return f"(with placed as (select {at.format('src')} part, {at.format('dst')} dest, dst from edges where src in (select id from nodes)) {_MESSAGES.format(strategy)})"


SQL |= {
    "pagerank_resumed": SQL["pagerank"],
    "spam_ensemble_files": SQL["spam_ensemble_vote"],
    "bigram_stripe_shares": f"with {_BI} select a, count(*) n, round(sum(n / t), 6) total, round(max(n / t), 8) most, arg_min(b, b) b, round(arg_min(n / t, b), 8) share from (select a, b, n, sum(n) over (partition by a) t from bi) group by 1",
    "ppr_dump": f"with {_PUR}{_ppr_ctes(4, _PUR_SOURCES)} select source, place::int place, printf('%.5f %d', rank, id) line from (select source, id, rank, row_number() over (partition by source order by rank desc, id) place from r4 where rank > 0) where place <= 10",
    "pagerank_purchases": f"with {_PUR}{_rank_ctes(4)} select id, round(rank, 8) rank from r4",
    "pagerank_ranged": f"with {_PUR}{_rank_ctes(4)} select id, round(rank, 8) rank from r4",
    "pagerank_log": f"with {_PUR}{_rank_ctes(4)} select id, round(ln(rank), 7) log_rank from r4",
    "pagerank_counters": f"with {_PUR}{_rank_ctes(3)}, live as (select dst from edges where src in (select id from nodes)), c as (select count(*) messages, count(distinct dst) received, count(distinct dst) filter (dst not in (select id from nodes)) missing from live) "
    + "select round::int round, messages, received, messages - received saved, missing, round(mass, 8) mass from c, (" + " union all ".join(f"select {k} round, sum(inc) mass from i{k}" for k in (1, 2, 3)) + ")",
    "partition_messages": f"with {_PUR} {_placed('modulo')} union all {_placed('range')}",
    "ppr_vectors": f"with {_PUR}{_ppr_ctes(4, _PUR_SOURCES)} select source, id, round(rank, 8) rank from r4 where rank > 0",
    "ppr_vectors_top": f"with {_PUR}{_ppr_ctes(4, _PUR_SOURCES)} select source, id, rank from (select source, id, round(rank, 8) rank, row_number() over (partition by source order by round(rank, 8) desc, id) p from r4 where rank > 0) where p <= 10",
    "ppr_log": f"with {_PUR}{_ppr_ctes(4, [2])} select id, case when rank > 0 then round(ln(rank), 7) end log_rank from r4",
    "pagerank_copartitioned": SQL["pagerank"],
    "pagerank_settled": f"with {_NAT}{_rank_ctes(60)} select id, round(rank, 5) rank from r60",
    "ppr_settled": f"with {_NAT}{_ppr_ctes(60, [5])} select id, round(rank, 5) rank from r60",
    "bool_rpn_stored": SQL["bool_rpn"],
    "bool_rpn_compressed": SQL["bool_rpn"],
    "bool_rpn_keyed": SQL["bool_rpn"],
    "keyed_word_count": SQL["word_count"],
    "keyed_get": f"with {_TOK} select word, count(*) n from words where word in ('the', 'und', 'shor', 'nosuchterm') group by 1",
    "bool_fetch": r"""with l as (select unnest(string_split(text, chr(10))) line from documents),
t as (select line, list_transform(regexp_split_to_array(lower(line), '[ \t\n\r\f]+'), lambda x: regexp_replace(x, '^[^a-z]+|[^a-z]+$', '', 'g')) w from l)
select case when length(line) > 80 then substr(line, 1, 80) || '...' else line end snippet, count(*) n from t where (list_contains(w, 'the') and list_contains(w, 'of')) or (list_contains(w, 'de') and list_contains(w, 'la')) group by 1""",
    "line_offsets": "select count(*) n_lines, count(*) n_keys, cast(sum(length(line)) as bigint) n_chars, cast(sum(octet_length(encode(line)) + 1) as bigint) n_bytes from (select unnest(string_split(text, chr(10))) line from documents)",
    "bool_and_compressed": SQL["bool_and"],
    "index_compressed": f"with {_IDX}, blocks as (select term, doc_id // 65536 range, ceil(count(*) / 128)::bigint n from idx group by 1, 2), b as (select term, cast(sum(n) as bigint) n_blocks from blocks group by 1) select term, n_blocks, count(*) df, min(doc_id) first_doc, max(doc_id) last_doc, cast(sum(tf) as bigint) sum_tf from idx join b using (term) group by 1, 2",
    "index_decode_compressed": SQL["inverted_index_long"],
    "word_lookup_stored": f"with {_IDX} select term, count(*) df, cast(sum(tf) as bigint) n from idx where term = 'the' group by 1",
    "bigram_stripes": f"with {_BI} select a, string_agg(b || ':' || n, ',' order by b) stripe from bi group by 1",
    "line_scan": "select count(*) n_lines, cast(sum(length(line)) as bigint) n_chars from (select unnest(string_split(text, chr(10))) line from documents)",
    "delimited_scan": "select o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) o_totalprice, cast(o_orderdate as date) o_orderdate, o_orderpriority from orders",
    "adjacency_scan": SQL["graph_build"],
    "instance_scan": f"with {_SPAM} select doc_id, label, cast(len(f) as bigint) n_features, cast(coalesce(list_sum(f), 0) as bigint) total from inst",
}
SQL["instances_concatenated"] = SQL["instance_scan"]
