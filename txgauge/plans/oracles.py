"""DuckDB SQL with the results of the registered queries."""

from __future__ import annotations

from txgauge.plans.surrogates import CODE, LETTERS

ORACLES: dict[str, str] = {}

SEQ = "coalesce(text, '')"
DNA = f"translate({SEQ}, '{LETTERS}', '{CODE}')"


def _n(letters: str, seq: str = "s") -> str:
    return f"(length({seq}) - length(regexp_replace({seq}, '[{letters}]', '', 'g')))"


_C = f"c AS (SELECT doc_id AS contig_idx, doc_id::VARCHAR AS name, {SEQ} AS s, length({SEQ})::BIGINT AS n FROM documents)"

ORACLES["seq_composition"] = f"""
WITH {_C}, b AS (SELECT *, {_n("aA")} AS a, {_n("cC")} AS c, {_n("gG")} AS g, {_n("tT")} AS t FROM c)
SELECT name, a AS bases_a, c AS bases_c, g AS bases_g, t AS bases_t, n - a - c - g - t AS bases_n, round(coalesce((g + c) / nullif(n, 0), 0), 6)::DOUBLE AS prop_gc FROM b
"""

_PAIRS = [x + y for x in "acgtn" for y in "acgtn"]
ORACLES["seq_dinucleotide"] = f"""
WITH {_C}, f AS (SELECT contig_idx, name, regexp_replace(translate(s, 'ACGT', 'acgt'), '[^acgt]', 'n', 'g') AS s FROM c),
p AS (SELECT contig_idx, unnest(list_zip(string_split(s, '')[:-2], string_split(s, '')[2:])) AS z FROM f),
k AS (SELECT contig_idx, {", ".join(f"count(*) FILTER (z[1] = '{d[0]}' AND z[2] = '{d[1]}') AS {d}_" for d in _PAIRS)} FROM p GROUP BY contig_idx)
SELECT name, {", ".join(f"coalesce({d}_, 0) AS {d}" for d in _PAIRS)} FROM f LEFT JOIN k USING (contig_idx)
"""

_ORF = f"""
q AS (SELECT doc_id AS contig_idx, length({SEQ})::BIGINT AS n, regexp_replace({DNA}, '[^ACGT]', 'N', 'g') AS x FROM documents),
strands AS (SELECT contig_idx, false AS back, x FROM q UNION ALL SELECT contig_idx, true, reverse(x) FROM q),
frames AS (SELECT contig_idx, back, k, regexp_extract_all(substr(x, k), '...') AS l FROM strands, (VALUES (1), (2), (3)) v(k)),
codons AS (SELECT contig_idx, back, k, unnest(l) AS codon, generate_subscripts(l, 1) AS i FROM frames),
marked AS (
  SELECT contig_idx, back, k, i,
    CASE WHEN back THEN codon IN ('ATC', 'ATT', 'ACT') ELSE codon IN ('TAG', 'TAA', 'TGA') END AS stop,
    CASE WHEN back THEN codon = 'TAC' ELSE codon = 'ATG' END AS start FROM codons),
segments AS (SELECT *, sum(stop::INT) OVER (PARTITION BY contig_idx, back, k ORDER BY i) AS seg FROM marked),
orfs AS (
  SELECT contig_idx, CASE WHEN seg = 0 THEN count(*) ELSE coalesce(max(i) - min(i) FILTER (start) + 1, 0) END AS orf
  FROM segments GROUP BY contig_idx, back, k, seg),
longest AS (SELECT contig_idx, n, coalesce(max(orf), 0)::BIGINT AS orf_length FROM q LEFT JOIN orfs USING (contig_idx) GROUP BY contig_idx, n)
"""
ORACLES["seq_longest_orf"] = f"WITH {_ORF} SELECT contig_idx::VARCHAR AS name, orf_length FROM longest"
ORACLES["assembly_basic_stats"] = f"""
WITH {_ORF}, t AS (SELECT count(*) AS k, coalesce(sum(n) FILTER (n >= 200), 0)::DOUBLE AS long FROM longest)
SELECT any_value(k)::BIGINT AS n_seqs, min(n) AS smallest, max(n) AS largest, sum(n)::BIGINT AS n_bases, round(any_value(long) / any_value(k), 6)::DOUBLE AS mean_len,
  count(*) FILTER (n < 200) AS n_under_200, count(*) FILTER (n > 1000) AS n_over_1k, count(*) FILTER (n > 10000) AS n_over_10k,
  count(*) FILTER (n >= 200 AND orf_length > 149) AS n_with_orf,
  round(coalesce(300.0::DOUBLE * sum(orf_length) FILTER (n >= 200) / nullif(any_value(k) * (any_value(long) / any_value(k)), 0), 0), 6)::DOUBLE AS mean_orf_percent
FROM longest, t
"""
ORACLES["assembly_nx"] = f"""
WITH RECURSIVE {_C},
r AS (SELECT n, row_number() OVER (ORDER BY n, contig_idx) AS i, sum(n) OVER (ORDER BY n, contig_idx ROWS UNBOUNDED PRECEDING) AS cum FROM c WHERE n >= 200),
w(k, i, n) AS (
  SELECT 0, 0::BIGINT, 0::BIGINT
  UNION ALL
  SELECT w.k + 1, x.i, x.n FROM w, LATERAL (
    SELECT i, n FROM r WHERE i > w.i AND cum >= (SELECT sum(n) FROM c)::DOUBLE * [0.1::DOUBLE, 0.3::DOUBLE, 0.5::DOUBLE, 0.7::DOUBLE, 0.9::DOUBLE][w.k + 1] ORDER BY i LIMIT 1) x
  WHERE w.k < 5),
b AS (SELECT max(n) AS top FROM c)
SELECT {", ".join(f"coalesce((SELECT n FROM w WHERE k = {k}), top)::BIGINT AS n{p}" for k, p in enumerate((90, 70, 50, 30, 10), 1))} FROM b
"""
ORACLES["assembly_gc"] = f"""
WITH {_C}, b AS (SELECT n, {_n("cgCG")} AS gc, {_n("acgtACGT")} AS known FROM c)
SELECT round(coalesce(sum(gc)::DOUBLE / nullif(sum(known), 0), 0), 6)::DOUBLE AS gc, (sum(n) - sum(known))::BIGINT AS bases_n, round(coalesce((sum(n) - sum(known))::DOUBLE / nullif(sum(n), 0), 0), 6)::DOUBLE AS proportion_n FROM b
"""
ORACLES["duplicate_names"] = "SELECT p_brand AS name, count(*) AS n FROM part GROUP BY p_brand HAVING count(*) > 1"

_REFS = """
refs AS (SELECT n_nationkey AS ref_id, n_name AS name, 600 + (n_nationkey * 37) % 1500 AS length FROM nation),
quant AS (SELECT name, length - 99 AS eff_len, ref_id::DOUBLE AS tpm, (((ref_id // 2) * 97) % 1000)::DOUBLE AS eff_count FROM refs)
"""
ORACLES["prior_table"] = f"""
WITH {_REFS}, p AS (SELECT r.ref_id, r.name, coalesce(q.eff_count, 0) + 1e-3::DOUBLE AS prior FROM refs r LEFT JOIN (SELECT * FROM quant WHERE tpm < 20) q USING (name))
SELECT ref_id, name, round(prior, 6) AS prior, round(ln(prior), 6) AS log_prior FROM p
"""
_ALN = f"""
{_REFS},
g AS (
  SELECT l_orderkey AS f, (l_suppkey % 25)::INT AS ref_id, (l_linenumber % 2)::INT AS mate, min((floor(l_quantity)::BIGINT % 12)::INT) AS nm, min(l_partkey) AS part
  FROM lineitem GROUP BY ALL),
aln AS (
  SELECT f * 64 + ref_id * 2 + mate AS ord, f AS fragment_idx, ref_id, nm, (part % (600 + (ref_id * 37) % 1500))::INT AS pos,
    ((ref_id + CASE WHEN f % 5 = 0 THEN 1 ELSE 0 END) % 25)::INT AS next_ref_id, pos + CASE WHEN mate = 1 THEN 120 ELSE -120 END AS next_pos, f % 6 AS kind,
    (1 + CASE WHEN mate = 1 THEN 96 ELSE 144 END + CASE WHEN f % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN f % 7 = 0 THEN 8 ELSE 0 END
     + CASE WHEN nm > 8 THEN 256 ELSE 0 END + CASE WHEN f % 11 = 0 THEN 4 ELSE 0 END)::INT AS flag FROM g),
mapped AS (SELECT *, nm * ln(0.01::DOUBLE) + (100 - nm) * ln(0.99::DOUBLE) AS ll, CASE WHEN flag & 128 > 0 THEN 2 ELSE 1 END AS bit FROM aln WHERE flag & 4 = 0),
cand AS (SELECT fragment_idx, ref_id, sum(ll) AS ll, bit_or(bit) AS own FROM mapped GROUP BY ALL),
cand2 AS (SELECT *, bit_count(bit_or(own) OVER (PARTITION BY fragment_idx)) - bit_count(own) AS missing FROM cand),
cand3 AS (
  SELECT fragment_idx, c.ref_id, r.name, coalesce(q.eff_count, 0) + 1e-3::DOUBLE AS prior, ln(coalesce(q.eff_count, 0) + 1e-3::DOUBLE) + ll + missing * (15 * ln(0.01::DOUBLE) + 85 * ln(0.99::DOUBLE)) AS score
  FROM cand2 c JOIN refs r USING (ref_id) LEFT JOIN quant q USING (name)),
best AS (
  SELECT fragment_idx, ref_id FROM (SELECT *, row_number() OVER (PARTITION BY fragment_idx ORDER BY round(score, 9) DESC, prior DESC, name) AS k FROM cand3) WHERE k = 1),
asg AS (SELECT ord, m.fragment_idx, m.ref_id, flag & ~256 AS flag, pos, nm, next_ref_id, next_pos, kind FROM mapped m JOIN best b ON m.fragment_idx = b.fragment_idx AND m.ref_id = b.ref_id)
"""
ORACLES["fragment_candidates"] = f"WITH {_ALN} SELECT fragment_idx, ref_id, name, round(prior, 6) AS prior, round(score, 6) AS score FROM cand3"
ORACLES["fragment_assign"] = f"WITH {_ALN} SELECT ord, fragment_idx, ref_id, flag, pos, nm FROM asg"
_ACC = f"""
{_ALN},
acc AS (
  SELECT r.ref_id, r.name, count(ord) AS reads_mapped, 100 * count(ord) AS bases_mapped,
    count(*) FILTER (flag & 64 > 0 OR (flag & 128 > 0 AND flag & 8 > 0)) AS fragments_mapped,
    count(*) FILTER (flag & 64 > 0 AND flag & 8 = 0) AS both_mapped,
    count(*) FILTER (flag & 64 > 0 AND flag & 8 = 0 AND flag & 2 > 0) AS properpair,
    count(*) FILTER (flag & 64 > 0 AND flag & 8 = 0 AND a.ref_id <> next_ref_id) AS bridges,
    count(*) FILTER (flag & 64 > 0 AND flag & 8 = 0 AND a.ref_id = next_ref_id AND abs(pos - next_pos) <= 400 AND pos < next_pos) AS good,
    count(*) FILTER (kind IN (3, 4)) AS clipped_alignments, 10 * count(*) FILTER (kind IN (3, 4)) AS clipped_bases, 10 * count(*) FILTER (kind = 3) AS leading_clipped_bases,
    count(ord) AS scored_alignments, coalesce(sum(nm), 0)::BIGINT AS edit_distance_total
  FROM refs r LEFT JOIN asg a USING (ref_id) GROUP BY r.ref_id, r.name)
"""
ORACLES["contig_accumulate"] = f"WITH {_ACC} SELECT * FROM acc"
_PARTS = """CASE WHEN reads_mapped > 0 THEN (35 * scored_alignments - edit_distance_total) / (35 * reads_mapped) ELSE 1 END::DOUBLE AS p_seq_true,
  CASE WHEN fragments_mapped > 1 THEN good / fragments_mapped ELSE 0 END::DOUBLE AS p_good"""
ORACLES["p_seq_true_p_good"] = f"WITH {_ACC}, p AS (SELECT ref_id, {_PARTS} FROM acc) SELECT ref_id, round(p_seq_true, 6) AS p_seq_true, round(p_good, 6) AS p_good FROM p"
_COV = """
blocks AS (
  SELECT a.ref_id, pos + b.o AS s, least(pos + b.o + b.n, r.length) AS e FROM asg a JOIN refs r USING (ref_id)
  JOIN (VALUES (0, 0, 100), (1, 0, 50), (1, 60, 50), (2, 0, 90), (3, 0, 90), (4, 0, 90), (5, 0, 40), (5, 60, 60)) b(kind, o, n) ON a.kind = b.kind
  WHERE pos + b.o < r.length),
depth AS (SELECT ref_id, p, count(*) AS d FROM (SELECT ref_id, unnest(range(s, e)) AS p FROM blocks) GROUP BY ALL),
every AS (SELECT ref_id, length, p, coalesce(d, 0) AS d FROM (SELECT ref_id, length, unnest(range(length)) AS p FROM refs) LEFT JOIN depth USING (ref_id, p)),
binned AS (SELECT ref_id, p // (length // 30 + 1) AS bin, sum(d)::BIGINT // count(*) AS mean FROM every GROUP BY ref_id, length, bin),
states AS (
  SELECT ref_id, x.bin::INT AS bin, CASE WHEN coalesce(mean, 0) = 0 THEN 0 ELSE least(24, length(bin(mean)) - 1) END::INT AS state
  FROM (SELECT ref_id, unnest(range(30)) AS bin FROM refs) x LEFT JOIN binned USING (ref_id, bin))
"""
ORACLES["coverage_runs"] = f"""
WITH {_ALN}, {_COV}, i AS (SELECT *, p - row_number() OVER (PARTITION BY ref_id, d ORDER BY p) AS island FROM every WHERE d > 0)
SELECT ref_id, min(p)::INT AS start, (max(p) + 1)::INT AS "end", d AS depth FROM i GROUP BY ref_id, d, island
"""
ORACLES["bases_uncovered"] = f"WITH {_ALN}, {_COV} SELECT ref_id, count(*) FILTER (d = 0) AS bases_uncovered FROM every GROUP BY ref_id"
ORACLES["bin_states"] = f"WITH {_ALN}, {_COV} SELECT ref_id, bin, state FROM states"
_SEG = """
folded AS (SELECT ref_id, bin, least(greatest(state, 0), 23) AS s FROM states),
k0 AS (SELECT ref_id, lgamma(24) - lgamma(54) + sum(lgamma(c + 1)) AS l FROM (SELECT ref_id, s, count(*) AS c FROM folded GROUP BY ALL) GROUP BY ref_id),
halves AS (
  SELECT ref_id, i, sum(lgamma(24) / d + lgamma(c + 1)) AS l FROM (
    SELECT ref_id, i, s, bin < i AS leftmost, count(*) AS c, count(*) OVER (PARTITION BY ref_id, i, bin < i) AS d
    FROM folded, (SELECT unnest(range(1, 30)) AS i) GROUP BY ref_id, i, s, bin < i) GROUP BY ref_id, i),
k1 AS (SELECT ref_id, sum(exp(h.l - lgamma(24 + i) - lgamma(54 - i) - k.l)) / 29 AS x FROM halves h JOIN k0 k USING (ref_id) GROUP BY ref_id),
seg AS (SELECT ref_id, 0.7::DOUBLE / (0.7::DOUBLE + 0.3::DOUBLE * x) AS p_not_segmented FROM k1)
"""
ORACLES["p_not_segmented"] = f"WITH {_ALN}, {_COV}, {_SEG} SELECT ref_id, round(p_not_segmented, 6) AS p_not_segmented FROM seg"
ORACLES["segmentation_many"] = f"""
WITH states AS (
  SELECT c_custkey AS ref_id, bin, CASE WHEN bin < c_custkey % 31 THEN c_custkey % 7 ELSE (c_custkey * 3 + bin * (c_custkey % 4)) % 26 END::INT AS state
  FROM customer, (SELECT unnest(range(30)) AS bin)), {_SEG}
SELECT ref_id, round(p_not_segmented, 6) AS p_not_segmented FROM seg
"""
ORACLES["soft_clip_summary"] = f"""
WITH {_ACC}, t AS (
  SELECT sum(reads_mapped)::BIGINT AS alignments, sum(clipped_alignments)::BIGINT AS clipped_alignments, sum(clipped_bases)::BIGINT AS clipped_bases, sum(leading_clipped_bases)::BIGINT AS leading_clipped_bases FROM acc)
SELECT *, round(coalesce(100 * clipped_alignments / nullif(alignments, 0), 0), 6)::DOUBLE AS percent_clipped,
  round(coalesce(clipped_bases / nullif(clipped_alignments, 0), 0), 6)::DOUBLE AS mean_clip, round(coalesce(leading_clipped_bases / nullif(clipped_alignments, 0), 0), 6)::DOUBLE AS mean_leading_clip FROM t
"""
_FRAG = """
rec AS (
  SELECT event_id AS ord, event_id // 2 AS q, ((user_id * 37 + event_id * 11) % 500)::INT AS pos, event_id % 2 = 0 AS first, event_id % 17 = 0 AS un
  FROM events WHERE event_id % 23 <> 0),
pairs AS (
  SELECT *, CASE WHEN un THEN -1 ELSE pos END AS p1, lag(q) OVER (ORDER BY ord) AS q0, lag(CASE WHEN un THEN -1 ELSE pos END) OVER (ORDER BY ord) AS p0,
    pos + CASE WHEN first THEN 150 ELSE -150 END AS mate FROM rec),
sizes AS (
  SELECT row_number() OVER (ORDER BY ord) AS k, CASE WHEN p1 > p0 THEN p1 - p0 + 100 ELSE p0 - p1 + 100 END::DOUBLE AS x FROM pairs
  WHERE q = q0 AND p1 >= 0 AND p0 >= 0 AND NOT (first AND p1 > mate) AND NOT (NOT first AND mate > p1) ORDER BY ord LIMIT 10000)
"""
ORACLES["fragment_size_faithful"] = f"""
WITH RECURSIVE {_FRAG}, l AS (SELECT list(x ORDER BY k) AS a FROM sizes),
f(k, m, s) AS (
  SELECT 1::BIGINT, a[1], 0::DOUBLE FROM l WHERE len(a) > 0
  UNION ALL
  SELECT k + 1, m + (a[k + 1] - m) / k, s + (a[k + 1] - m) * (a[k + 1] - (m + (a[k + 1] - m) / k)) FROM f, l WHERE k < len(a))
SELECT coalesce((SELECT floor(3 * CASE WHEN k > 1 THEN sqrt(s / (k - 1)) ELSE 0 END + list_sum(a)::BIGINT // len(a)) FROM f, l ORDER BY k DESC LIMIT 1), 0)::BIGINT AS realistic_distance, (SELECT count(*) FROM sizes) AS n_pairs
"""
ORACLES["fragment_size_plain"] = f"WITH {_FRAG} SELECT coalesce(floor(3 * coalesce(stddev_samp(x), 0) + avg(x)), 0)::BIGINT AS realistic_distance, count(*) AS n_pairs FROM sizes"


def _scored(run: int, name: str) -> str:
    gc = "p_partkey % 61 / 60" + (" + CASE WHEN p_partkey % 40 = 0 THEN 3e-6::DOUBLE WHEN p_partkey % 90 = 0 THEN 0.25::DOUBLE ELSE 0 END" if run == 1 else "")
    return f"""
{name}_0 AS (
  SELECT p_partkey AS k, p_partkey::VARCHAR AS contig_name, p_size::BIGINT AS good, p_brand AS brand, (p_partkey * {17 + run} % 1000)::DOUBLE / 10.0::DOUBLE AS tpm, (p_partkey * 31 % 400)::DOUBLE / 4.0::DOUBLE AS coverage,
    300 + p_partkey % 2000 AS length, {gc} AS prop_gc, p_partkey % 333 AS orf_length,
    ((p_partkey * 3 + p_size) % 52)::DOUBLE / 51.0::DOUBLE AS cov, ((p_partkey * 7 + {run} * (p_partkey % 3)) % 102)::DOUBLE / 101.0::DOUBLE AS seg,
    ((p_partkey * 13) % 98)::DOUBLE / 97.0::DOUBLE AS ord, ((p_partkey * 29 + {run}) % 90)::DOUBLE / 89.0::DOUBLE AS nuc FROM part),
{name} AS (
  SELECT *, greatest(cov, 0.01::DOUBLE) AS c, greatest(seg, 0.01::DOUBLE) AS s, greatest(ord, 0.01::DOUBLE) AS g, greatest(nuc, 0.01::DOUBLE) AS q, greatest(c * s * g * q, 0.01::DOUBLE) AS score FROM {name}_0)"""


_A, _B = _scored(0, "a"), _scored(1, "b")
ORACLES["contig_scores"] = f"""
WITH {_A} SELECT contig_name, round(score, 6) AS score, round(s * g * q, 6) AS without_cov, round(c * g * q, 6) AS without_seg, round(c * s * q, 6) AS without_good, round(c * s * g, 6) AS without_seq FROM a
"""
ORACLES["assembly_score"] = f"""
WITH {_A} SELECT round(exp(avg(ln(score))) * 0.7::DOUBLE, 6) AS score, round(sum(score * tpm) / count(*) * 0.7::DOUBLE, 6) AS weighted, sum(good)::BIGINT AS good FROM a
"""
_CURVE = f"""
{_A},
walk AS (
  SELECT score, row_number() OVER w AS i, count(*) OVER () - row_number() OVER w AS left_n,
    sum(ln(score)) OVER (ORDER BY score DESC, k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS left_log,
    sum(good) OVER (ORDER BY score DESC, k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS left_good
  FROM a WINDOW w AS (ORDER BY score, k)),
curve AS (SELECT score AS cutoff, max_by(exp(left_log / left_n) * (left_good / 10000000), i) AS assembly_score FROM walk WHERE left_n > 0 GROUP BY score)
"""
ORACLES["score_curve"] = f"WITH {_CURVE} SELECT round(cutoff, 6) AS cutoff, round(assembly_score, 6) AS assembly_score FROM curve"
ORACLES["optimal_cutoff"] = f"""
WITH {_CURVE} SELECT round(coalesce(max(assembly_score), 0), 6)::DOUBLE AS optimal_score, round(coalesce(min(cutoff) FILTER (assembly_score = (SELECT max(assembly_score) FROM curve)), 0), 6)::DOUBLE AS cutoff FROM curve WHERE assembly_score > 0
"""
ORACLES["classify"] = f"WITH {_A} SELECT brand, CASE WHEN score >= 0.05::DOUBLE THEN 'good' ELSE 'bad' END AS classification, count(*) AS n FROM a GROUP BY ALL"
_ALL = f"""
{_ACC}, {_COV}, {_SEG},
own AS (SELECT ref_id::BIGINT AS contig_idx, name, length FROM refs UNION ALL SELECT 25, 'UNSEEN', 500),
unc AS (SELECT ref_id, count(*) FILTER (d = 0) AS u FROM every GROUP BY ref_id),
met AS (
  SELECT contig_idx, o.name AS contig_name, o.length, o.length % 7 / 7 AS prop_gc, (o.length // 9)::BIGINT AS orf_length, coalesce(bridges, 0) AS in_bridges, a.ref_id IS NOT NULL AS headed, q.name IS NOT NULL AS expressed,
    coalesce(u, o.length) AS u, coalesce(fragments_mapped, 0) AS fm, coalesce(good, 0) AS good,
    coalesce(CASE WHEN fragments_mapped > 1 THEN good / fragments_mapped END, 0)::DOUBLE AS p_good, 1 - coalesce(u, o.length) / o.length AS p_bases_covered,
    CASE WHEN a.ref_id IS NULL THEN 0 WHEN reads_mapped > 0 THEN (35 * scored_alignments - edit_distance_total) / (35 * reads_mapped) ELSE 1 END::DOUBLE AS p_seq_true,
    coalesce(p_not_segmented, 1) AS p_not_segmented, coalesce(eff_len, 0)::BIGINT AS eff_length, coalesce(eff_count, 0) AS eff_count, coalesce(tpm, 0) AS tpm, coalesce(eff_count * 100 / nullif(eff_len, 0), 0) AS coverage
  FROM own o LEFT JOIN acc a USING (name) LEFT JOIN unc USING (ref_id) LEFT JOIN seg USING (ref_id) LEFT JOIN (SELECT * FROM quant WHERE tpm < 20) q ON q.name = o.name),
con AS (
  SELECT *, greatest(greatest(p_bases_covered, 0.01::DOUBLE) * greatest(p_not_segmented, 0.01::DOUBLE) * greatest(p_good, 0.01::DOUBLE) * greatest(p_seq_true, 0.01::DOUBLE), 0.01::DOUBLE) AS score FROM met)
"""
_R6 = ", ".join(f"round({c}, 6)::DOUBLE AS {n}" for c, n in (("prop_gc", "prop_gc"), ("p_good", "p_good"), ("p_bases_covered", "p_bases_covered"), ("p_seq_true", "p_seq_true"), ("score", "score"), ("p_not_segmented", "p_not_segmented"), ("eff_count", "eff_count"), ("tpm", "tpm"), ("coverage", "coverage"), ("p_seq_true", '"sCnuc"'), ("p_bases_covered", '"sCcov"'), ("p_good", '"sCord"'), ("p_not_segmented", '"sCseg"')))
ORACLES["contigs_table"] = f"WITH {_ALL} SELECT contig_idx, contig_name, length, orf_length, in_bridges, eff_length, {_R6} FROM con"
ORACLES["read_stats"] = f"""
WITH {_ALL}, t AS (
  SELECT sum(fm)::BIGINT AS fragments_mapped, sum(good)::BIGINT AS good_mappings, count(*) FILTER (in_bridges > 1) AS potential_bridges, sum(u) FILTER (headed)::BIGINT AS bases_uncovered,
    count(*) FILTER (headed AND u > 0) AS contigs_uncovbase, count(*) FILTER (expressed AND coverage < 1) AS contigs_uncovered, count(*) FILTER (expressed AND coverage < 10) AS contigs_lowcovered,
    count(*) FILTER (headed AND p_not_segmented < 0.5) AS contigs_segmented, count(*) AS n, sum(length) AS b FROM con)
SELECT 15000::BIGINT AS fragments, fragments_mapped, good_mappings, fragments_mapped - good_mappings AS bad_mappings, potential_bridges, bases_uncovered, contigs_uncovbase, contigs_uncovered, contigs_lowcovered, contigs_segmented,
  round(fragments_mapped / 15000, 6)::DOUBLE AS p_fragments_mapped, round(good_mappings / 15000, 6)::DOUBLE AS p_good_mapping, round(bases_uncovered / b, 6)::DOUBLE AS p_bases_uncovered, round(contigs_uncovbase / n, 6)::DOUBLE AS p_contigs_uncovbase,
  round(contigs_uncovered / n, 6)::DOUBLE AS p_contigs_uncovered, round(contigs_lowcovered / n, 6)::DOUBLE AS p_contigs_lowcovered, round(contigs_segmented / n, 6)::DOUBLE AS p_contigs_segmented FROM t
"""


def _differ(k: str) -> str:
    apart = f"abs(a.{k}::DOUBLE - b.{k}::DOUBLE)"
    return f"SELECT '{k}' AS metric, count(*) AS n, count(*) FILTER ({apart} > 1e-5::DOUBLE) AS differing, round(coalesce(max({apart}), 0), 6)::DOUBLE AS worst FROM a JOIN o b USING (contig_name)"


ORACLES["compare_validity"] = f"""
WITH {_A}, {_B}, o AS (SELECT * REPLACE (CASE WHEN k % 50 = 49 THEN 'x' || contig_name ELSE contig_name END AS contig_name) FROM b)
{" UNION ALL ".join(_differ(k) for k in ("length", "prop_gc", "orf_length"))}
UNION ALL SELECT 'contig_set', count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL), count(*) FILTER (a.k IS NULL OR b.k IS NULL), 0 FROM a FULL JOIN o b USING (contig_name)
"""
ORACLES["compare_assembly_validity"] = f"""
WITH {_A}, {_B} SELECT 'n_seqs' AS metric, (SELECT count(*) FROM a)::VARCHAR AS base, (SELECT count(*) FROM b)::VARCHAR AS other, 'same' AS verdict
UNION ALL SELECT 'largest', (SELECT max(length) FROM a)::VARCHAR, (SELECT max(length) FROM b)::VARCHAR, 'same'
"""
ORACLES["compare_deltas"] = """
WITH g AS (SELECT sum(p_size)::DOUBLE AS m FROM part)
SELECT 'fragments' AS metric, 1e7::DOUBLE AS base, 1e7::DOUBLE AS other, 0::DOUBLE AS delta, 0::DOUBLE AS noise, 0::DOUBLE AS times_noise
UNION ALL SELECT 'good_mappings', m, m - 200, -200, 100, 2 FROM g
"""


def _row(run: int, name: str) -> str:
    return f"""r{run} AS (
  SELECT sc AS score, rate, sc / rate AS geo FROM (
    SELECT round(exp(avg(ln(score))) * ((sum(good) - {run * 100}) / 10000000), 9) AS sc, round((sum(good) - {run * 100}) / 10000000, 9)::DOUBLE AS rate FROM {name}))"""


ORACLES["compare_decomposition"] = f"""
WITH {_A}, {_B}, {_row(0, "a")}, {_row(1, "b")},
d AS (
  SELECT r0.score AS s0, r0.rate AS r0_, r0.geo AS g0, r1.score AS s1, r1.rate AS r1_, r1.geo AS g1, s1 - s0 AS total, g0 * (r1_ - r0_) AS from_rate, (g1 - g0) * r0_ AS from_contigs,
    total - g0 * (r1_ - r0_) - (g1 - g0) * r0_ AS residual FROM r0, r1)
SELECT round(s0, 6) AS base_score, round(r0_, 6) AS base_rate, round(g0, 6) AS base_geomean, round(s1, 6) AS other_score, round(r1_, 6) AS other_rate, round(g1, 6) AS other_geomean,
  round(total, 6) + 0 AS total, round(from_rate, 6) + 0 AS from_rate, round(from_contigs, 6) + 0 AS from_contigs, round(residual, 6) + 0 AS residual,
  abs(total) > 1e-12::DOUBLE AND abs(residual) > 0.02::DOUBLE * abs(total) AS unexplained FROM d
"""


def _moves(metric: str, x: str) -> str:
    x = f"(b.{x} - a.{x})"
    up, down = f"count(*) FILTER ({x} > 1e-6::DOUBLE)", f"count(*) FILTER ({x} < -1e-6::DOUBLE)"
    return f"""SELECT '{metric}' AS metric, count(*) AS n, {up} + {down} AS changed, round(({up} + {down}) / count(*), 6)::DOUBLE AS p_changed, round(avg({x}), 6) + 0 AS mean,
  round(coalesce(stddev_samp({x}) / sqrt(count(*)), 0), 6)::DOUBLE AS se, round(coalesce(quantile_cont({x}, 0.5) FILTER (abs({x}) > 1e-6::DOUBLE), 0), 6)::DOUBLE + 0 AS median_changed,
  round(max(abs({x})), 6) AS max_abs, {up} AS up, {down} AS down, round(coalesce(({up} - {down}) / nullif(sqrt({up} + {down}), 0), 0), 6)::DOUBLE AS z FROM a JOIN b USING (contig_name)"""


ORACLES["compare_paired"] = f"WITH {_A}, {_B} " + " UNION ALL ".join(_moves(m, x) for m, x in (("score", "score"), ("sCnuc", "nuc"), ("sCcov", "cov"), ("sCord", "ord"), ("sCseg", "seg"), ("coverage", "coverage"), ("tpm", "tpm")))
ORACLES["compare_rank"] = f"""
WITH {_A}, {_B}, j AS (SELECT a.score AS x, b.score AS y, a.score >= 0.05::DOUBLE AS ga, b.score >= 0.06::DOUBLE AS gb FROM a JOIN b USING (contig_name))
SELECT round(corr(x, y), 6) AS pearson, count(*) FILTER (ga AND gb) AS both_good, count(*) FILTER (NOT ga AND NOT gb) AS both_bad, count(*) FILTER (ga AND NOT gb) AS lost, count(*) FILTER (NOT ga AND gb) AS gained,
  round((count(*) FILTER (ga = gb)) / count(*), 6)::DOUBLE AS agree FROM j
"""
ORACLES["compare_discordance"] = f"""
WITH {_A}, {_B}, j AS (SELECT a.k, a.score AS x, b.score AS y FROM a JOIN b USING (k)), n AS (SELECT count(*) AS n FROM a),
r AS (SELECT n, unnest(range(CASE WHEN n <= 3000 THEN n * n ELSE 2000000 END)) AS id FROM n),
h AS (SELECT n, id, CASE WHEN n > 3000 THEN md5(id::VARCHAR) END AS h FROM r),
p AS (SELECT CASE WHEN n <= 3000 THEN id // n ELSE ('0x' || substr(h, 1, 15))::BIGINT % n END AS i, CASE WHEN n <= 3000 THEN id % n ELSE ('0x' || substr(h, 17, 15))::BIGINT % n END AS j FROM h
  WHERE CASE WHEN n <= 3000 THEN i < j ELSE i <> j END),
d AS (SELECT sign(u.x - v.x) AS dx, sign(u.y - v.y) AS dy FROM p JOIN j u ON u.k = p.i JOIN j v ON v.k = p.j)
SELECT round(count(*) FILTER (dx * dy < 0) / nullif(count(*) FILTER (dx * dy <> 0), 0), 6)::DOUBLE AS discordance, round(1 - count(*) FILTER (dx * dy <> 0) / count(*), 6)::DOUBLE AS ties FROM d
"""
_PICK = f"""
{_A}, {_B}, mem AS (SELECT (k % 37)::VARCHAR || '.' || brand AS label, k, contig_name AS name FROM a),
sa AS (SELECT contig_name AS name, score FROM a WHERE k % 11 <> 0), sb AS (SELECT contig_name AS name, score FROM b WHERE k % 12 <> 0),
grp AS (SELECT label, count(*) AS size, count(x.score) AS fo, count(y.score) AS fn FROM mem LEFT JOIN sa x USING (name) LEFT JOIN sb y USING (name) GROUP BY label),
po AS (SELECT label, name AS op, score FROM (SELECT label, m.name, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, k) AS r FROM mem m JOIN sa USING (name)) WHERE r = 1),
pn AS (SELECT label, name AS np, score FROM (SELECT label, m.name, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, k) AS r FROM mem m JOIN sb USING (name)) WHERE r = 1),
cmp AS (
  SELECT label, size, fo, fn, op AS old_pick, np AS new_pick,
    CASE WHEN op IS NULL AND np IS NULL THEN 'neither' WHEN np IS NULL THEN 'only_old' WHEN op IS NULL THEN 'only_new' WHEN op = np THEN 'same' ELSE 'changed' END AS outcome,
    po.score - coalesce(x.score, 0) AS old_margin, pn.score - coalesce(y.score, 0) AS new_margin
  FROM grp LEFT JOIN po USING (label) LEFT JOIN pn USING (label) LEFT JOIN sa x ON x.name = np LEFT JOIN sb y ON y.name = op)
"""
ORACLES["group_picks"] = f"WITH {_PICK} SELECT label, op AS pick FROM po"
ORACLES["pick_changes"] = f"""
WITH {_PICK} SELECT count(*) AS groups, sum(size)::BIGINT AS slots, {", ".join(f"count(*) FILTER (outcome = '{k}') AS {k}" for k in ("same", "changed", "only_old", "only_new", "neither"))},
  count(*) FILTER (outcome = 'changed' AND greatest(old_margin, new_margin) < 0.01::DOUBLE) AS near_ties, sum(fo)::BIGINT AS found_old, sum(fn)::BIGINT AS found_new,
  round(sum(fo) / sum(size), 6)::DOUBLE AS share_old, round(sum(fn) / sum(size), 6)::DOUBLE AS share_new,
  round(count(*) FILTER (outcome = 'changed') / nullif(count(*) FILTER (outcome IN ('same', 'changed')), 0), 6)::DOUBLE AS rate, least(sum(fo), sum(fn)) / sum(size) >= 0.9::DOUBLE AS enough_members FROM cmp
"""
ORACLES["pick_changes_by_size"] = f"""
WITH {_PICK} SELECT size::INT AS size, count(*) AS groups, count(*) FILTER (outcome = 'changed') AS changed, round(count(*) FILTER (outcome = 'changed') / count(*), 6)::DOUBLE AS rate FROM cmp GROUP BY size HAVING count(*) >= 10
"""
ORACLES["pick_disagreements"] = f"""
WITH {_PICK} SELECT label, size::INT AS size, old_pick, new_pick, round(old_margin, 6) AS old_margin, round(new_margin, 6) AS new_margin FROM cmp WHERE outcome = 'changed' ORDER BY greatest(old_margin, new_margin) DESC, label LIMIT 10
"""
ORACLES["merged_metrics"] = """
SELECT n_name AS pair_id, '' AS organism, CASE WHEN n_nationkey % 3 <> 0 THEN coalesce(r_name, '') ELSE '' END AS lineage, '' AS platform, '' AS assembly_accession, coalesce(m.n::VARCHAR, '') AS n_read_pairs,
  'results/' || n_name AS result_dir, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey::VARCHAR ELSE '' END AS score, CASE WHEN n_nationkey % 2 = 1 THEN n_nationkey::VARCHAR ELSE '' END AS cutoff
FROM nation LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) m ON m.c_nationkey = n_nationkey
"""
ORACLES["missing_jobs"] = """
SELECT DISTINCT c_custkey::VARCHAR AS pair_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IS NOT NULL)
"""
ORACLES["fasta_records"] = f"""
WITH c AS (SELECT doc_id, translate({DNA}, chr(10) || chr(13) || chr(9) || ' >', 'NNNNN') AS s FROM documents)
SELECT doc_id::VARCHAR AS name, length(CASE WHEN s = '' THEN 'N' ELSE s END)::BIGINT AS length, md5(CASE WHEN s = '' THEN 'N' ELSE s END) AS seq_md5 FROM c
"""
ORACLES["quant_table"] = "SELECT s_name AS name, (s_suppkey % 5000)::INT AS length, s_suppkey % 900 AS eff_len, 12.5::DOUBLE AS tpm, s_suppkey::DOUBLE AS eff_count FROM supplier"
ORACLES["manifest_table"] = "SELECT c_name AS pair_id, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 4 + 1 END AS n_read_pairs FROM customer"
ORACLES["orthogroup_lines"] = """
WITH g AS (SELECT s_nationkey, replace(string_agg(s_name, ',' ORDER BY s_name), '#', '') AS members, count(*) AS size, row_number() OVER (ORDER BY s_nationkey) AS r FROM supplier GROUP BY 1)
SELECT r || '.groups' AS label, size, members FROM g WHERE s_nationkey <> 3
"""
ORACLES["score_columns"] = f"WITH {_A} SELECT contig_name AS name, round(score, 6) AS score FROM a WHERE k % 9 <> 0"
ORACLES["run_summary"] = f"""
SELECT d.total AS d_score, d.from_rate AS d_goodrate, d.from_contigs AS d_geomean, r.pearson, x.discordance AS rank_disc
FROM ({ORACLES["compare_decomposition"]}) d, ({ORACLES["compare_rank"]}) r, ({ORACLES["compare_discordance"]}) x
"""
ORACLES["alignment_lines"] = """
WITH g AS (SELECT l_orderkey AS f, (l_suppkey % 25)::INT AS ref_id, (l_linenumber % 2)::INT AS mate FROM lineitem GROUP BY ALL),
d AS (SELECT ref_id, f % 6 AS kind, (f * 64 + ref_id * 2 + mate) % 50 <> 0 AS fits FROM g)
SELECT ref_id, count(*) FILTER (fits) AS records, count(*) FILTER (NOT fits) AS skipped, sum(CASE WHEN kind IN (3, 4) THEN 10 ELSE 0 END) FILTER (fits)::BIGINT AS clipped,
  sum(CASE kind WHEN 0 THEN 100 WHEN 1 THEN 110 WHEN 5 THEN 120 ELSE 90 END) FILTER (fits)::BIGINT AS covered FROM d GROUP BY ref_id
"""
