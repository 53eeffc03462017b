"""DuckDB twins of the op queries that SQL can express."""

OP6 = r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT size, md5(coalesce(doc_id::VARCHAR, '')) k FROM documents),
s AS (SELECT source, sum(size)::BIGINT source_size FROM d GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, [3.0, 1.0, 2.0][rank % 3 + 1]::DOUBLE weight, source_size * 2.0::DOUBLE cap, (sum(source_size) OVER ())::DOUBLE * 1.5 demand FROM r),
l AS (SELECT *, (demand - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) level FROM w),
f AS (SELECT arg_min(level, struct_pack(a := cap / weight, b := rank)) level FROM l WHERE level * weight <= cap),
t AS (SELECT l.source, source_size, rank, least(cap, f.level * weight) target, floor(least(cap, f.level * weight))::BIGINT budget FROM l, f),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.budget, t.rank, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
g AS (SELECT *, greatest(0, least(size, budget - start)) one, greatest(0, least(size, budget - start - source_size)) two, (start + size / 2.0::DOUBLE) / target part FROM p)
SELECT doc_id, size, source_size, target, (one + two)::BIGINT taken, ((size > 0 AND 2 * (budget - start) >= size)::BIGINT + (size > 0 AND 2 * (budget - start - source_size) >= size)::BIGINT) copies,
 CASE WHEN one > 0 THEN least(1.0, greatest(0.0, CASE rank % 3
  WHEN 0 THEN CASE WHEN part <= 1.0 THEN 2 * part / (1.5 + sqrt(greatest(0.0, 2.25 + -2.0 * part))) ELSE 1.0 END
  WHEN 1 THEN CASE WHEN part <= 0.3125 THEN 2 * part / (0.5 + sqrt(greatest(0.0, 0.25 + part))) WHEN part <= 1.0 THEN 0.5 + 2 * (part - 0.3125) / (0.75 + sqrt(greatest(0.0, 0.5625 + 5.0 * (part - 0.3125)))) ELSE 1.0 END
  ELSE CASE WHEN part <= 1.0 THEN 2 * part / (1.0 + sqrt(1.0)) ELSE 1.0 END END)) END::DOUBLE AS position
FROM g"""

OP8 = """WITH t AS (SELECT conv_id, turn, coalesce(nullif(role, ''), 'unknown') speaker, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker perspective FROM t WHERE speaker <> 'system'),
r AS (SELECT t.*, p.perspective, CASE WHEN speaker = 'system' THEN speaker WHEN speaker = perspective THEN 'assistant' ELSE 'user' END chat_role FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, '<|im_start|>' || chat_role || CASE WHEN chat_role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) head FROM r),
s AS (SELECT *, head || text || '<|im_end|>' || chr(10) segment FROM h),
w AS (SELECT *, sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS UNBOUNDED PRECEDING)::BIGINT AS stop FROM s)
SELECT conv_id, perspective, turn, speaker, chat_role, segment, (chat_role = 'assistant')::INT mask, stop - length(segment) AS start, stop,
 stop - length(segment) + length(head) mask_start, stop - length(segment) + length(head) + length(text) mask_stop FROM w"""

OP9 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) e FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""


OP13 = r"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') t FROM documents),
r AS (SELECT *, first_value(doc_id) OVER w keep_id, count(*) OVER (PARTITION BY t) group_size, row_number() OVER w n FROM d WINDOW w AS (PARTITION BY t ORDER BY chars DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, n = 1 kept, sha256(t) text_sha256 FROM r"""


def op11(k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: str = "3") -> str:
    """Each round compares every vector with every centroid; m is a centroid's number, c its components."""
    square = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT"
    steps = []
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, any_value(vec_id) vec_id, any_value(x) x, min(struct_pack(d := {square}, m := m)) best FROM v, c{n} GROUP BY r)")
        sums = f"SELECT best.m m, i, sum(x[i])::BIGINT s, count(*) n FROM a{n}, unnest(range(1, {size + 1})) u(i) GROUP BY ALL"
        means = f"SELECT m, list((s - (s % n + n) % n) // n ORDER BY i)::BIGINT[] c FROM ({sums}) GROUP BY m"
        steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c{n}.m, coalesce(t.c, c{n}.c) c FROM c{n} LEFT JOIN ({means}) t ON c{n}.m = t.m)")
    chain = ",\n".join(steps[:-1])
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) x FROM embeddings
 WHERE embedding IS NOT NULL AND len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, x) - 1 m, x c FROM (SELECT sha256('{seed}:' || vec_id) h, x FROM v ORDER BY h NULLS LAST, x LIMIT {k})),
{chain}
SELECT vec_id, best.m::INT AS "cluster", best.d distance, sum(best.d) OVER (PARTITION BY best.m)::BIGINT cluster_inertia, sum(best.d) OVER ()::BIGINT inertia,
 sha256(array_to_string(c, ',')) centroid_sha256 FROM a{rounds} JOIN c{rounds} ON best.m = c{rounds}.m"""


def op2(words: dict, classes: dict, class_rule: tuple, word_rule: tuple, least: int, parts: int) -> str:
    """The quality rules; words and classes are the operator's tables, rules its limits."""
    lists = " ".join(f"WHEN '{k}' THEN [{', '.join(map(repr, w))}]" for k, w in words.items())
    counts = ", ".join(f"len(regexp_extract_all(t, '[{body.replace(chr(39), chr(39) * 2)}]'))" for body in classes.values())
    term = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / ({0} + {1})) ELSE 0 END"
    x, y = "(b[i] / list_sum(b)::DOUBLE)", "(r[i] / list_sum(r)::DOUBLE)"
    dist = f"sqrt(greatest(0, list_sum(list_transform(range(1, len(b) + 1), lambda i: {term.format(x, y)} + {term.format(y, x)})) / 2))"
    return rf"""WITH d AS (SELECT row_number() OVER () id, doc_id, coalesce(text, '') t, CASE WHEN lang IN ({', '.join(map(repr, words))}) THEN lang ELSE 'other' END k FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls, CASE k {lists} ELSE [] END::VARCHAR[] own FROM d),
g AS (SELECT id, i, list_slice(ws, i, i + 4) g FROM w, unnest(range(1, len(ws) - 3)) u(i)),
r AS (SELECT id, count(DISTINCT i + j)::BIGINT n FROM (SELECT id, i, count(*) OVER (PARTITION BY id, g) c FROM g), unnest(range(0, 5)) u(j) WHERE c > 1 GROUP BY 1),
f AS (SELECT w.id, doc_id, k, len(ws)::BIGINT n_words, length(array_to_string(ws, ''))::BIGINT word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT n_dup_lines, coalesce(r.n, 0) n_repeat_words, length(t) chars, [{counts}] cs, list_transform(own, lambda o: len(list_filter(ws, lambda x: x = o))) bins FROM w LEFT JOIN r ON w.id = r.id),
h AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words base_failed, list_concat(cs, [chars - word_chars, word_chars - list_sum(cs)])::BIGINT[] c, list_concat(bins, [n_words - coalesce(list_sum(bins), 0)])::BIGINT[] b FROM f),
s AS (SELECT k, which, i, sum(floor(v[i] * {parts} / list_sum(v)::DOUBLE)::BIGINT)::BIGINT x FROM (SELECT k, 'c' which, c v FROM h WHERE NOT base_failed AND n_words >= {least} UNION ALL SELECT k, 'b', b FROM h WHERE NOT base_failed AND n_words >= {least}), unnest(range(1, len(v) + 1)) u(i) GROUP BY ALL),
q AS (SELECT k, list(x ORDER BY i) FILTER (WHERE which = 'c') rc, list(x ORDER BY i) FILTER (WHERE which = 'b') rb FROM s GROUP BY 1),
e AS (SELECT h.*, rc, rb FROM h LEFT JOIN q ON h.k = q.k),
m AS (SELECT *, (SELECT CASE WHEN list_sum(b) > 0 THEN {dist} END FROM (SELECT e.c b, e.rc r)) class_distance, (SELECT CASE WHEN list_sum(b) > 0 THEN {dist} END FROM (SELECT e.b b, e.rb r)) word_distance FROM e)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND NOT coalesce(n_words >= {class_rule[0]} AND class_distance > {class_rule[1]}, false) AND NOT coalesce(n_words >= {word_rule[0]} AND word_distance > {word_rule[1]} + {word_rule[2]} / sqrt(n_words), false) kept FROM m"""
