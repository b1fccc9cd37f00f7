"""SQL of the same operations for a second engine (DuckDB), put together from parts."""

from __future__ import annotations

from .config import Rag
from .functions.text import PUNCTUATION, SPACES

CMAX, DMAX, RATE, OVERLAP, TOPK, BATCH, SEED = 128, 512, 16, 32, 5, 4, 42
LEAST = 102


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def recursive(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def u32(key: str, draw: str, last: str | None = None) -> str:
    more = f", CAST({last} AS VARCHAR)" if last else ""
    return f"('0x' || substr(md5(concat_ws('|', '{SEED}', CAST({key} AS VARCHAR), '{draw}'{more})), 1, 8))::BIGINT"


def md5_real(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0)"


def clean(x: str) -> str:
    return f"replace(replace({x}, '<RET>', '< RET >'), '<MEM>', '< MEM >')"


def tok(x: str) -> str:
    return f"(CASE WHEN {x} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split({x}, ' ') END)"


def joined(x: str) -> str:
    return f"array_to_string({x}, ' ')"


def mem(n: str) -> str:
    return f"list_transform(range({n}), lambda z: '<MEM>')"


def with_mem(x: str) -> str:
    return f"list_concat({x}, {mem(f'len({x}) // {RATE} + 1')})"


def normalize(x: str) -> str:
    return f"trim(regexp_replace(translate(lower({x}), {quoted(PUNCTUATION)}, ''), {quoted('[' + SPACES + ']+')}, ' ', 'g'))"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, {quoted('[' + SPACES + ']+')}), lambda w: w <> '')"


UNSCORED = "('<AE>', '<pad>', '<s>', '<MEM>')"


def mask_special(x: str) -> str:
    return f"list_transform({x}, lambda e: CASE WHEN e IN {UNSCORED} THEN '-100' ELSE e END)"


def mask_before_mem(x: str) -> str:
    last = f"coalesce(list_max(list_transform(range(1, len({x}) + 1), lambda i: CASE WHEN {x}[i] = '<MEM>' THEN i ELSE 0 END)), 0)"
    return f"list_transform(range(1, len({x}) + 1), lambda j: CASE WHEN j <= {last} THEN '-100' ELSE {x}[j] END)"


def mask_prefix(x: str, prefix: str, margin: int) -> str:
    return f"list_transform(range(1, len({x}) + 1), lambda j: CASE WHEN j - 1 < len(list_filter({x}, lambda e: e = '<pad>')) - {margin} + {prefix} THEN '-100' ELSE {x}[j] END)"


def unmask(values: str, labels: str) -> str:
    return f"list_transform(range(1, len({values}) + 1), lambda u: CASE WHEN ({labels})[u] = '-100' THEN '<pad>' ELSE ({values})[u] END)"


def counted(x: str) -> str:
    return f"list_filter({x}, lambda e: e <> '-100')"


def decode(x: str) -> str:
    return f"list_filter({x}, lambda d: d NOT IN ('<AE>', '<pad>', '<s>', '</s>', '<MEM>'))"


TEXTS = "p AS (SELECT DISTINCT doc_id, text FROM pretrain_in WHERE text IS NOT NULL)"
TOKENS = TEXTS + f",\nt AS (SELECT doc_id, {tok('x')} AS tk FROM (SELECT doc_id, {clean('text')} AS x FROM p))"
BATCHES = f"b AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // {BATCH} AS batch_id FROM p)"


def chunks(overlap: int) -> str:
    step = CMAX - overlap
    return f"c AS (SELECT doc_id, st // {step} AS chunk_no, tk[st + 1 : st + {CMAX}] AS chunk FROM (SELECT doc_id, tk, unnest(range(0, len(tk), {step})) AS st FROM t))"


def padded(source: str) -> str:
    return f"w AS (SELECT *, list_concat(list_transform(range(width - len(ids)), lambda z: '<pad>'), ids) AS padded FROM (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS width FROM {source}))"


def tail(source: str, n: str) -> str:
    """Random chunks without a tiny tail, one row a chunk; k = 0 is the start."""
    rest = "(n - pos - size)"
    size = f"CASE WHEN {rest} <= {CMAX} THEN {rest} WHEN {rest} - {CMAX} < {LEAST} THEN {CMAX} - ({LEAST} - ({rest} - {CMAX})) ELSE {LEAST} + {u32('doc_id', 'tail', 'k + 1')} % {CMAX - LEAST + 1} END"
    return f"r AS (SELECT doc_id, {n} AS n, 0::BIGINT AS k, 0::BIGINT AS pos, 0::BIGINT AS size FROM {source} UNION ALL SELECT doc_id, n, k + 1, pos + size, {size} FROM r WHERE {rest} > 0)"


RANDOM_K = (
    f"kk AS (SELECT doc_id, len(tk) AS n, CASE WHEN len(tk) > 1 THEN (len(tk) + {CMAX - 1}) // {CMAX} + 1 ELSE len(tk) END AS k FROM t WHERE len(tk) > 0),\n"
    f"rk AS (SELECT doc_id, k, 0::BIGINT AS i, CAST(n AS BIGINT) AS rest, 0::BIGINT AS size FROM kk UNION ALL SELECT doc_id, k, i + 1, rest - drawn, drawn FROM (SELECT *, low + {u32('doc_id', 'parts', 'i + 1')} % (high - low + 1) AS drawn FROM (SELECT *, greatest(1, rest - (k - i - 1) * {CMAX}) AS low, least({CMAX}, rest - (k - i - 1)) AS high FROM rk WHERE i < k)))"
)
VOCABULARY = "v AS (SELECT lower(word) AS token, min(rank_no) AS rank FROM common_words WHERE word IS NOT NULL GROUP BY 1)"
AUTOENCODE = (
    tail("t", f"CAST(CASE WHEN len(tk) <= 64 THEN 0 ELSE least(len(tk), {DMAX}) END AS BIGINT)"),
    f"mm AS (SELECT doc_id, CAST(count(*) FILTER (WHERE k > 0) AS BIGINT) AS parts, CAST(coalesce(sum(size // {RATE} + 1) FILTER (WHERE k > 0), 0) AS BIGINT) AS mems FROM r GROUP BY doc_id)",
    f"am AS (SELECT t.doc_id, tk, CASE WHEN len(tk) <= 64 THEN 1 ELSE parts END AS n_chunks, CASE WHEN len(tk) <= 64 THEN len(tk) // {RATE} + 1 ELSE mems END AS n_mem FROM t JOIN mm ON t.doc_id = mm.doc_id)",
    f"auto AS (SELECT doc_id, n_chunks, n_mem, list_concat(list_concat(list_concat(['<AE>'], {mem('n_mem')}), list_concat(['<s>'], tk)), ['</s>'])[1:{DMAX}] AS decoder FROM am)",
)
CONTINUATION = (
    f"s0 AS (SELECT doc_id, tk[1:{CMAX + DMAX}] AS ids, {u32('doc_id', 'split')} % 32 AS s FROM t)",
    f"s1 AS (SELECT *, least(s + {CMAX}, len(ids) // 2) AS idx FROM s0)",
    "s2 AS (SELECT *, least(s, idx // 2) AS split FROM s1)",
    "parts AS (SELECT doc_id, ids[1:split] AS t1, ids[split + 1:idx] AS t2, ids[idx + 1:] AS t3 FROM s2)",
    f"cont AS (SELECT doc_id, len(t2) // {RATE} + 1 AS n_mem, list_concat(list_concat(list_concat(['<s>'], t1), {mem(f'len(t2) // {RATE} + 1')}), list_concat(t3, ['</s>']))[1:{DMAX}] AS decoder FROM parts)",
)
PRETRAIN = (
    *AUTOENCODE,
    *CONTINUATION,
    f"rows AS (SELECT t.doc_id, CASE WHEN auto_task THEN 'autoencode' ELSE 'continuation' END AS task, CASE WHEN auto_task THEN n_chunks ELSE 1 END AS n_chunks, CASE WHEN auto_task THEN auto.n_mem ELSE cont.n_mem END AS n_mem, CASE WHEN auto_task THEN auto.decoder ELSE cont.decoder END AS decoder FROM (SELECT doc_id, {u32('doc_id', 'task')} / 4294967296.0 < 0.5 AS auto_task FROM t) t JOIN auto ON t.doc_id = auto.doc_id JOIN cont ON t.doc_id = cont.doc_id)",
)

QUESTIONS = "q AS (SELECT DISTINCT ex_id, coalesce(list_transform(docs, lambda d: coalesce(d, '')), CAST([] AS VARCHAR[])) AS docs, query, label FROM rag_in WHERE query IS NOT NULL)"
NMEMS = f"n AS (SELECT ex_id, query, label, list_transform(docs[1:{TOPK}], lambda d: least(len({tok(clean('d'))}), {CMAX}) // {RATE} + 1) AS m FROM q)"
_SYSTEM, _USER = Rag().system_prompt, Rag().user_prompt
_SECTION = "array_to_string(list_transform(range(1, len(m) + 1), lambda k: 'Document ' || (k - 1) || ':' || repeat(' <MEM>', m[k])), ' ')"
_TURN = "'<|{0}|> ' || {1} || ' <|end|>'"
_HEAD = f"'<|system|> ' || {quoted(_SYSTEM)} || ' <|end|>' || ' ' || '<|user|> ' || usr || ' <|end|>'"
PROMPTS = (
    f"us AS (SELECT ex_id, m, {clean('label')} AS answer, replace(replace({quoted(_USER)}, '[documents]', {_SECTION}), '[question]', {clean('query')}) AS usr FROM n),\n"
    f"pr AS (SELECT *, {_HEAD} || coalesce(' ' || '<|assistant|> ' || answer || ' <|end|>', '') AS chat, {_HEAD} || ' ' || '<|assistant|> ' || '' || ' <|end|>' AS opened FROM us)"
)
RAG_ROWS = (
    f"r0 AS (SELECT ex_id, answer, CAST(coalesce(list_sum(m), 0) AS BIGINT) AS n_mem, len({tok('opened')}) AS prefix, {tok('chat')}[1:{DMAX}] AS decoder FROM pr),\n"
    f"rr AS (SELECT *, CASE WHEN answer IS NULL THEN list_transform(decoder, lambda x: '-100') ELSE {mask_special(mask_prefix('decoder', 'prefix', 4))} END AS labels FROM r0)"
)
_STEP = CMAX - OVERLAP
CHUNKED = (
    f"d0 AS (SELECT ex_id, query, label, list_transform(docs[1:{TOPK}], lambda d: list_transform(range(0, len({tok(clean('d'))}), {_STEP})[1:3], lambda st: least({CMAX}, len({tok(clean('d'))}) - st))) AS lens FROM q),\n"
    f"d1 AS (SELECT ex_id, query, label, lens, list_transform(lens, lambda l: CAST(coalesce(list_sum(list_transform(l, lambda y: y // {RATE} + 1)), 0) AS BIGINT)) AS m FROM d0),\n"
    "n AS (SELECT ex_id, query, label, m FROM d1),\n"
    "ch AS (SELECT ex_id, CAST(coalesce(list_sum(list_transform(lens, lambda l: len(l))), 0) AS BIGINT) AS n_chunks, array_to_string(list_transform(range(1, len(m) + 1), lambda k: 'Document ' || (k - 1) || ':' || repeat('<MEM>', m[k])), '') AS section FROM d1)"
)

STEPS = (
    "tj AS (SELECT DISTINCT traj_id, list_transform(steps, lambda s: coalesce(s, '')) AS steps FROM traj_in WHERE len(steps) > 0)",
    f"s0 AS (SELECT traj_id, k - 1 AS step_no, {tok('x')} AS tk FROM (SELECT traj_id, k, {clean('steps[k]')} AS x FROM (SELECT traj_id, steps, unnest(range(1, len(steps) + 1)) AS k FROM tj)))",
    f"st AS (SELECT traj_id, step_no, tk, len(tk) AS n, {u32('traj_id', 'step', 'step_no')} / 4294967296.0 < 0.5 AS flag, (len(tk) + {CMAX - 1}) // {CMAX} AS n_chunks, (len(tk) // {CMAX}) * {CMAX // RATE + 1} + CASE WHEN len(tk) % {CMAX} > 0 THEN (len(tk) % {CMAX}) // {RATE} + 1 ELSE 0 END AS mems FROM s0)",
)


def budget(source: str, name: str) -> str:
    room = f"({DMAX} - before - 1)"
    return (
        f"{name}_0 AS (SELECT *, coalesce(sum(CASE WHEN flag THEN mems ELSE n END + 1) OVER (PARTITION BY traj_id ORDER BY step_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {source}),\n"
        f"{name} AS (SELECT *, CAST(CASE WHEN flag THEN mems WHEN n <= {room} THEN n WHEN {room} >= 0 THEN {room} ELSE greatest(n - 1, 0) END AS BIGINT) AS kept FROM {name}_0 WHERE before <= {DMAX})"
    )


FORCED = (
    budget("st", "b1"),
    "ma AS (SELECT traj_id, sum(CASE WHEN flag THEN n_chunks ELSE 0 END) AS made FROM b1 GROUP BY traj_id)",
    "fo AS (SELECT st.traj_id, step_no, tk, n, n_chunks, mems, made = 0 AS forced, flag OR (made = 0 AND step_no = 0) AS flag FROM st JOIN ma ON st.traj_id = ma.traj_id)",
    budget("fo", "b2"),
    f"sq AS (SELECT traj_id, step_no, forced, flag, n_chunks, kept, list_concat([chr(10)], CASE WHEN flag THEN {mem('kept')} ELSE tk[1:kept] END) AS seq FROM b2)",
)
TRAJ_ROWS = "tr AS (SELECT traj_id, count(*) AS n_steps, bool_or(forced) AS forced, CAST(sum(CASE WHEN flag THEN n_chunks ELSE 0 END) AS BIGINT) AS n_chunks, CAST(sum(CASE WHEN flag THEN kept ELSE 0 END) AS BIGINT) AS n_mem, flatten(list(seq ORDER BY step_no)) AS decoder FROM sq GROUP BY traj_id)"

HIDDEN = (
    "hi AS (SELECT vec_id // 8 AS ex_id, vec_id % 8 AS pos, embedding AS vec FROM embeddings WHERE vec_id % 3 = 0 AND embedding IS NOT NULL),\n"
    "g AS (SELECT ex_id, row_number() OVER (PARTITION BY ex_id ORDER BY pos) - 1 AS mem_ordinal, pos, list_transform(vec, lambda v: CAST(v AS DOUBLE)) AS vec FROM hi)"
)


def _weight(name: str, k: str) -> str:
    return f"(('0x' || substr(md5('{name}|' || CAST({k} AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0 - 0.5)"


CONNECTOR = (
    f"h1 AS (SELECT ex_id, mem_ordinal, list_transform(range(8), lambda h: greatest(0.1 + list_sum(list_transform(range(64), lambda d: vec[d + 1] * {_weight('w1', 'h * 64 + d')})), 0)) AS hid FROM g),\n"
    f"cn AS (SELECT ex_id, mem_ordinal, o, round(0.2 + list_sum(list_transform(range(8), lambda h: hid[h + 1] * {_weight('w2', 'o * 8 + h')})), 4) AS y FROM (SELECT *, unnest(range(4)) AS o FROM h1))"
)

PAIRS = "pa AS (SELECT DISTINCT ex_id, coalesce(prediction, '') AS prediction, reference FROM pairs_in WHERE reference IS NOT NULL)"
F1 = (
    f"hh AS (SELECT ex_id, md5(prediction || '|' || reference) AS h, {words('prediction')} AS a, {words('reference')} AS b FROM pa)",
    "tk2 AS (SELECT ex_id, h, token, sum(s) AS p, sum(1 - s) AS r FROM (SELECT ex_id, h, unnest(a) AS token, 1 AS s FROM hh UNION ALL SELECT ex_id, h, unnest(b), 0 FROM hh) GROUP BY ex_id, h, token)",
    "ov AS (SELECT ex_id, h, sum(least(p, r)) AS overlap FROM tk2 GROUP BY ex_id, h)",
    "f1 AS (SELECT hh.ex_id, hh.h, CAST(coalesce(overlap, 0) AS BIGINT) AS overlap, len(a) AS n_pred, len(b) AS n_ref FROM hh LEFT JOIN ov ON hh.ex_id = ov.ex_id AND hh.h = ov.h)",
)
F1_SCORES = "CASE WHEN overlap > 0 THEN round(2.0 * overlap / (n_pred + n_ref), 6) ELSE 0.0 END AS f1, CASE WHEN overlap > 0 THEN round(overlap / n_pred, 6) ELSE 0.0 END AS precision, CASE WHEN overlap > 0 THEN round(overlap / n_ref, 6) ELSE 0.0 END AS recall"
F1_MULTI = with_(
    QUESTIONS,
    f"mr AS (SELECT ex_id, k, {words('label')} AS a, {words('docs[k]')} AS b FROM (SELECT ex_id, label, docs, unnest(range(1, greatest(len(docs), 1) + 1)) AS k FROM q WHERE label IS NOT NULL))",
    "tk2 AS (SELECT ex_id, k, token, sum(s) AS p, sum(1 - s) AS r FROM (SELECT ex_id, k, unnest(a) AS token, 1 AS s FROM mr UNION ALL SELECT ex_id, k, unnest(coalesce(b, CAST([] AS VARCHAR[]))), 0 FROM mr) GROUP BY ex_id, k, token)",
    "ov AS (SELECT ex_id, k, sum(least(p, r)) AS overlap FROM tk2 GROUP BY ex_id, k)",
    "fm AS (SELECT mr.ex_id, coalesce(overlap, 0) AS overlap, len(a) AS n_pred, coalesce(len(b), 0) AS n_ref FROM mr LEFT JOIN ov ON mr.ex_id = ov.ex_id AND mr.k = ov.k)",
) + f"SELECT ex_id, max(f1) AS f1, max(precision) AS precision, max(recall) AS recall FROM (SELECT ex_id, {F1_SCORES} FROM fm) GROUP BY ex_id"


def grams(x: str, n: int) -> str:
    w = words(x)
    if n == 1:
        return f"list_distinct({w})"
    return f"list_distinct(list_transform(range(1, greatest(len({w}) - {n - 1}, 0) + 1), lambda i: array_to_string(({w})[i : i + {n - 1}], ' ')))"


def rouge(a: str, b: str, n: int) -> str:
    x, y = grams(a, n), grams(b, n)
    return f"CASE WHEN len(list_intersect({x}, {y})) > 0 THEN round(2.0 * len(list_intersect({x}, {y})) / (len({x}) + len({y})), 6) ELSE 0.0 END"


_HITS = f"list_transform({words('prediction')}, lambda x: list_transform({words('reference')}, lambda y: CASE WHEN x = y THEN 1 ELSE 0 END))"
_CELL = "greatest(acc[i], CASE WHEN hit[i] = 1 THEN 1 + CASE WHEN i = 1 THEN 0 ELSE acc[i - 1] END ELSE 0 END)"
#: One row of the table after another, each cell the best of those before it.
_LCS = f"list_last(list_reduce(list_concat([list_transform({words('reference')}, lambda z: 0)], {_HITS}), lambda acc, hit: list_transform(range(1, len(acc) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda i: {_CELL})))))"
_COMMON = f"coalesce(list_sum(list_transform(list_intersect({words('prediction')}, {words('reference')}), lambda w: least(len(list_filter({words('prediction')}, lambda x: x = w)), len(list_filter({words('reference')}, lambda x: x = w))))), 0)"
SCORES = (
    f"s0 AS (SELECT ex_id, CASE WHEN len({words('prediction')}) > 0 AND len({words('reference')}) > 0 THEN {_LCS} ELSE 0 END AS lcs, {_COMMON} AS both_, len({words('prediction')}) AS np, len({words('reference')}) AS nr, {rouge('prediction', 'reference', 1)} AS rouge_1, {rouge('prediction', 'reference', 2)} AS rouge_2, CAST({normalize('prediction')} = {normalize('reference')} AS DOUBLE) AS em, CAST(contains({normalize('prediction')}, {normalize('reference')}) AS DOUBLE) AS m FROM pa),\n"
    "sc AS (SELECT ex_id, CASE WHEN lcs > 0 THEN round(2.0 * lcs / (np + nr), 6) ELSE 0.0 END AS rouge_l, rouge_1, rouge_2, em, m, CASE WHEN both_ > 0 THEN both_ / np ELSE 0.0 END AS precision, CASE WHEN both_ > 0 THEN both_ / nr ELSE 0.0 END AS recall, CASE WHEN both_ > 0 THEN 2.0 * both_ / (np + nr) ELSE 0.0 END AS f1 FROM s0)"
)
MEANS = tuple(", ".join(f"round(avg({c}), 4) AS {c}" for c in part) for part in (("rouge_1", "rouge_2", "rouge_l"), ("precision", "recall", "f1", "em", "m")))
MATCHED = f"pa AS (SELECT q.ex_id, {clean('p.prediction')} AS prediction, {clean('q.label')} AS reference FROM q JOIN (SELECT DISTINCT ex_id, coalesce(prediction, '') AS prediction FROM pairs_in WHERE reference IS NOT NULL) p ON p.ex_id = q.ex_id WHERE q.label IS NOT NULL)"
