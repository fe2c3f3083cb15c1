"""DuckDB SQL for the oracle check: an independent statement of each query's semantics.

DuckDB lists are 1-based and its lambdas are written ``lambda x, i: ...``.
"""

from __future__ import annotations

from spanweave.constants import PIECE_PATTERN, VOCAB_SIZE, WORD_MARK

SEED = "'42'"


def md5(*parts: str) -> str:
    return "md5(concat_ws(':', " + ", ".join([SEED] + [f"CAST({p} AS VARCHAR)" for p in parts]) + "))"


def uniform(n: str, *parts: str) -> str:
    return f"((('0x' || substr({md5(*parts)}, 1, 8))::BIGINT) % ({n}))"


def render(expr: str) -> str:
    return f"array_to_string({expr}, ' ')"


def fit(expr: str, n, pad=0) -> str:
    return f"list_resize({expr}, {n}, {pad})"


PIECES_CTE = f"""
pc_raw AS (
  SELECT doc_id, regexp_extract_all(' ' || text, '{PIECE_PATTERN}', 1) AS ws,
         regexp_extract_all(' ' || text, '{PIECE_PATTERN}', 2) AS core
  FROM documents),
pc AS (
  SELECT doc_id, list_transform(core, lambda c, i: CASE WHEN ws[i] = '' THEN c ELSE '{WORD_MARK}' || c END) AS pieces
  FROM pc_raw)"""

def _subword_rows() -> str:
    from spanweave.operators.vocab import read_subwords
    rows = ", ".join("('" + w.replace("'", "''") + f"', {r})" for r, w in enumerate(read_subwords()))
    return f"subwords(piece, rank) AS (VALUES {rows})" if rows else "subwords AS (SELECT '' AS piece, 0 AS rank WHERE false)"


VOCAB_CTE = f"""
piece_counts AS (
  SELECT piece, count(*) AS n FROM (SELECT unnest(pieces) AS piece FROM pc) GROUP BY piece),
{_subword_rows()},
piece_chars AS (
  SELECT substr(piece, i, 1) AS piece, sum(n) AS n
  FROM (SELECT piece, n, unnest(generate_series(1, length(piece))) AS i FROM piece_counts) GROUP BY 1),
char_pieces AS (
  SELECT piece, n FROM piece_chars WHERE piece NOT IN (SELECT piece FROM subwords) ORDER BY n DESC, piece
  LIMIT (SELECT ({VOCAB_SIZE} - 359 - count(*)) // 8 FROM subwords)),
ranked_pieces AS (
  SELECT piece, n, row_number() OVER (ORDER BY part, rank, n DESC, piece) AS r
  FROM (SELECT s.piece, s.rank, coalesce(c.n, 0) AS n, 0 AS part FROM subwords s LEFT JOIN piece_counts c ON c.piece = s.piece
        UNION ALL SELECT piece, 0, n, 1 FROM char_pieces
        UNION ALL SELECT piece, 0, n, 2 FROM piece_counts
        WHERE length(piece) > 1 AND piece NOT IN (SELECT piece FROM subwords))),
vocab AS (
  SELECT piece, (r + 258)::INTEGER AS id, n::BIGINT AS count FROM ranked_pieces WHERE r <= {VOCAB_SIZE} - 359)"""


def spelled_ctes(name: str, src: str, keys: list[str]) -> str:
    """``{name}``: (keys, pos, sub, tid) of the pieces in ``src``. A piece that is not in the vocabulary is cut
    into the longest entries from the left; a character without one is its UTF-8 bytes (ids 3 + byte)."""
    k = ", ".join(keys)
    return f"""
{name}_w AS (SELECT s.*, v.id AS tid FROM {src} s LEFT JOIN vocab v ON v.piece = s.piece),
{name}_u AS (SELECT DISTINCT piece FROM {name}_w WHERE tid IS NULL),
{name}_p AS (SELECT piece, unnest(generate_series(1, length(piece))) AS p FROM {name}_u),
{name}_h AS (SELECT a.piece, a.p, arg_max(v.id, a.len) AS tid, max(a.len) AS len
  FROM (SELECT piece, p, unnest(generate_series(1, least(16, length(piece) - p + 1))) AS len FROM {name}_p) a
  JOIN vocab v ON v.piece = substr(a.piece, a.p, a.len) GROUP BY a.piece, a.p),
{name}_g AS (SELECT a.piece, list_reduce(list({{'p': a.p, 'len': coalesce(h.len, 0), 'tid': coalesce(h.tid, -1)}} ORDER BY a.p),
    lambda acc, x: CASE WHEN x.p = acc.nxt THEN {{'nxt': acc.nxt + greatest(x.len, 1), 'hit': list_append(acc.hit, x)}} ELSE acc END,
    {{'nxt': 1::BIGINT, 'hit': []::STRUCT(p BIGINT, len BIGINT, tid INTEGER)[]}}).hit AS hit
  FROM {name}_p a LEFT JOIN {name}_h h ON h.piece = a.piece AND h.p = a.p GROUP BY a.piece),
{name}_x AS (SELECT piece, unnest(hit) AS x FROM {name}_g),
{name}_s AS (
  SELECT piece, x.p * 8 AS sub, x.tid AS tid FROM {name}_x WHERE x.tid >= 0
  UNION ALL
  SELECT piece, p * 8 + b, 3 + ('0x' || substr(raw, 2 * b + 1, 2))::INTEGER
  FROM (SELECT piece, x.p AS p, hex(encode(substr(piece, x.p, 1))) AS raw FROM {name}_x WHERE x.tid < 0),
       unnest(range(length(raw) // 2)) AS t(b)),
{name} AS (SELECT {k}, pos, 0 AS sub, tid FROM {name}_w WHERE tid IS NOT NULL
  UNION ALL SELECT {", ".join("w." + x for x in keys)}, w.pos, s.sub, s.tid FROM {name}_w w JOIN {name}_s s ON s.piece = w.piece
  WHERE w.tid IS NULL)"""


IDS_CTE = """
tok AS (
  SELECT doc_id, unnest(pieces) AS piece, unnest(generate_series(1, len(pieces))) AS pos FROM pc),""" + spelled_ctes(
    "tok_ids", "tok", ["doc_id"]) + """,
doc_ids AS (
  SELECT pc.doc_id, coalesce(list(t.tid ORDER BY t.pos, t.sub) FILTER (WHERE t.tid IS NOT NULL), []::INTEGER[]) AS ids
  FROM pc LEFT JOIN tok_ids t ON t.doc_id = pc.doc_id
  GROUP BY pc.doc_id)"""


def chunks_cte(max_len: int = 128) -> str:
    body = max_len - 1
    return f"""
chunk_seg AS (
  SELECT doc_id, c::INTEGER AS chunk, ids[c * {body} + 1 : c * {body} + {body}] || [1] AS seg
  FROM doc_ids, unnest(range(0, greatest(ceil(len(ids) / {body})::INTEGER, 1))) AS r(c)),
chunks AS (
  SELECT doc_id, chunk, CAST(doc_id AS VARCHAR) || ':' || CAST(chunk AS VARCHAR) AS row_key,
         {fit('seg', max_len)} AS input_ids,
         {fit('list_transform(seg, lambda x: 1)', max_len)} AS attention_mask
  FROM chunk_seg)"""


def corpus_ctes(max_len: int = 128) -> str:
    return "WITH " + ",".join([PIECES_CTE, VOCAB_CTE, IDS_CTE, chunks_cte(max_len)])


def segmentation(n_items: str, k: str, key: str, tag: str) -> str:
    h = md5(key, f"'{tag}'", "i")
    rank = f"((('0x' || substr({h}, 1, 8))::BIGINT << 20) + i)"
    cuts = (f"list_sort(list_transform(list_sort(list_transform(range(1, {n_items}), "
            f"lambda i: {rank}))[1 : {k} - 1], lambda r: (r & 1048575)::INTEGER))")
    return f"[0] || {cuts} || [{n_items}]"


def random_mask_ctes(src: str, n: str, key: str, density: float, mean: float, roll: bool,
                     float32: bool, out: str = "mask") -> str:
    """Rows of ``src`` plus column ``out``: E2/E3 mask over length ``n``."""
    L = f"greatest({n}, 2)"
    if float32:
        prod = f"CAST({L} AS FLOAT) * CAST({density!r} AS FLOAT)"
    else:
        prod = f"CAST({L} AS DOUBLE) * CAST({density!r} AS DOUBLE)"
    s = f"""
m1 AS (
  SELECT *, least(greatest(round_even({prod}, 0)::INTEGER, 1), {L} - 1) AS m_noise FROM {src}),
m2 AS (
  SELECT *, greatest(round_even(m_noise::DOUBLE / {mean!r}, 0)::INTEGER, 1) AS m_k FROM m1),
m3 AS (
  SELECT *, {segmentation('m_noise', 'm_k', key, 'noise')} AS m_nb,
            {segmentation(f'{L} - m_noise', 'm_k', key, 'clean')} AS m_cb FROM m2),
m4 AS (
  SELECT *, flatten(list_transform(range(m_k), lambda j:
              list_resize([]::INTEGER[], coalesce(m_cb[j + 2] - m_cb[j + 1], 0), 0)
              || list_resize([]::INTEGER[], coalesce(m_nb[j + 2] - m_nb[j + 1], 0), 1)))[1 : {n}] AS m_full FROM m3)"""
    if roll:
        s += f""",
m5 AS (
  SELECT *, ({uniform(L, key, "'roll'")} % greatest({n}, 1))::INTEGER AS m_off FROM m4),
m6 AS (
  SELECT * EXCLUDE (m_noise, m_k, m_nb, m_cb, m_full, m_off),
         CASE WHEN {n} = 0 THEN []::INTEGER[] ELSE m_full[{n} - m_off + 1 : {n}] || m_full[1 : {n} - m_off] END AS {out}
  FROM m5)"""
    else:
        s += f""",
m6 AS (SELECT * EXCLUDE (m_noise, m_k, m_nb, m_cb, m_full), m_full AS {out} FROM m4)"""
    return s


def sentinel(mask: str, vocab_size: int = VOCAB_SIZE) -> str:
    starts = f"list_filter(range(1, len({mask}) + 1), lambda p: {mask}[p] = 1 AND (p = 1 OR {mask}[p - 1] = 0))"
    return (f"list_transform({mask}, lambda b, p: CASE WHEN b = 1 AND (p = 1 OR {mask}[p - 1] = 0) "
            f"THEN {vocab_size} - list_position({starts}, p) WHEN b = 1 THEN -1 ELSE 0 END)")


def corrupt_select(ids: str, mask: str, input_length: int, target_length: int) -> tuple[str, str, str]:
    """(inputs, labels, decoder ids) SQL given a cleared mask column and a sentinel column 'sent'."""
    inputs = fit(f"list_filter(list_transform({ids}, lambda x, i: CASE WHEN sent[i] != 0 THEN sent[i] ELSE x END), "
                 f"lambda y: y != -1)", input_length)
    tgt = fit(f"list_filter(list_transform(sent, lambda s, j: CASE WHEN j > 1 AND sent[j - 1] != 0 "
              f"THEN {ids}[j - 1] ELSE s END), lambda y: y != 0)", target_length)
    labels = f"list_transform({tgt}, lambda y: CASE WHEN y = 0 THEN -100 ELSE y END)"
    dec = f"list_transform([0] || labels[1 : {target_length - 1}], lambda y: CASE WHEN y = -100 THEN 0 ELSE y END)"
    return inputs, labels, dec


def text_ids_ctes(name: str, table: str, keys: list[str], text: str = "text", eos: bool = True) -> str:
    """CTEs ``{name}_pc`` (pieces) and ``{name}_ids`` (ids, eos appended) for any text table.

    Needs the ``vocab`` CTE of the documents corpus.
    """
    k = ", ".join(keys)
    on = " AND ".join(f"t.{c} = p.{c}" for c in keys)
    kp = ", ".join(f"p.{c}" for c in keys)
    tail = " || [1]" if eos else ""
    return f""",
{name}_raw AS (
  SELECT {k}, regexp_extract_all(' ' || {text}, '{PIECE_PATTERN}', 1) AS ws,
         regexp_extract_all(' ' || {text}, '{PIECE_PATTERN}', 2) AS core FROM {table}),
{name}_pc AS (
  SELECT {k}, list_transform(core, lambda c, i: CASE WHEN ws[i] = '' THEN c ELSE '{WORD_MARK}' || c END) AS pieces
  FROM {name}_raw),
{name}_tok AS (
  SELECT {k}, unnest(pieces) AS piece, unnest(generate_series(1, len(pieces))) AS pos FROM {name}_pc),
{spelled_ctes(name + "_sp", name + "_tok", keys)},
{name}_ids AS (
  SELECT {kp}, coalesce(list(t.tid ORDER BY t.pos, t.sub) FILTER (WHERE t.tid IS NOT NULL), []::INTEGER[]){tail} AS ids
  FROM {name}_pc p LEFT JOIN {name}_sp t ON {on}
  GROUP BY {kp})"""


def vocab_ctes() -> str:
    return "WITH " + ",".join([PIECES_CTE, VOCAB_CTE])


def pack_ctes(length: int, group_docs: int) -> str:
    L = int(length)
    return f""",
pk0 AS (SELECT doc_id, ids, ((row_number() OVER (ORDER BY doc_id) - 1) // {group_docs})::BIGINT AS pack_group
        FROM docs_ids),
pk1 AS (SELECT *, len(ids) AS n,
        coalesce(sum(len(ids)) OVER (PARTITION BY pack_group ORDER BY doc_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS st FROM pk0),
pk2 AS (SELECT pack_group, doc_id, st, r::INTEGER AS row,
               ids[greatest(r * {L} - st, 0) + 1 : least((r + 1) * {L}, st + n) - st] AS piece
        FROM pk1, unnest(range(st // {L}, (st + n - 1) // {L} + 1)) t(r) WHERE n > 0),
packed AS (SELECT pack_group, row, flatten(list(piece ORDER BY st)) AS input_ids
           FROM pk2 GROUP BY pack_group, row HAVING len(flatten(list(piece ORDER BY st))) = {L})"""


def punct_literal() -> str:
    from spanweave.constants import ASCII_PUNCTUATION
    return "'" + ASCII_PUNCTUATION.replace("'", "''") + "'"


def words_ctes(name: str, src: str, keys: list[str], tokens: str = "tokens") -> str:
    """E4 in SQL: ``{name}`` = (keys, w, part, first, ntok, text) from a token-list column."""
    k = ", ".join(keys)
    seps = "('</s>', '<pad>')"
    return f""",
{name}_t AS (SELECT {k}, unnest({tokens}) AS tok, unnest(generate_series(0, len({tokens}) - 1)) AS i FROM {src}),
{name}_t1 AS (SELECT *, tok IN {seps} AS sep, lag(tok) OVER (PARTITION BY {k} ORDER BY i) AS prev FROM {name}_t),
{name}_t2 AS (SELECT *, (NOT sep AND (prev IS NULL OR prev IN {seps} OR starts_with(tok, '{WORD_MARK}')
                         OR contains({punct_literal()}, tok))) AS st FROM {name}_t1),
{name}_t3 AS (SELECT *, sum(st::INTEGER) OVER w - 1 AS w, sum(sep::INTEGER) OVER w AS part
              FROM {name}_t2 WINDOW w AS (PARTITION BY {k} ORDER BY i ROWS UNBOUNDED PRECEDING)),
{name} AS (SELECT {k}, w, min(part) AS part, min(i) AS first, count(*) AS ntok,
                  string_agg(lower(trim(tok, '{WORD_MARK}')), '' ORDER BY i) AS text
           FROM {name}_t3 WHERE NOT sep GROUP BY {k}, w)"""


def ngrams_cte(name: str, words: str, keys: list[str], sizes, same_part: bool = True) -> str:
    k = ", ".join(keys)
    parts = []
    for n in sizes:
        frame = f"(PARTITION BY {k} ORDER BY w ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)"
        parts.append(f"SELECT {k}, w AS s, {n} AS n, string_agg(text, ' ') OVER {frame} AS text, "
                     f"count(*) OVER {frame} AS cnt, max(part) OVER {frame} AS last_part, part FROM {words}")
    cond = "cnt = n" + (" AND last_part = part" if same_part else "")
    return f""",
{name} AS (SELECT {k}, s, n, text FROM ({' UNION ALL '.join(parts)}) WHERE {cond})"""


def mine_ctes(min_count: int, max_n: int = 5) -> str:
    """X1 in SQL over the documents corpus (needs ``pc``)."""
    from spanweave.operators.phrases import compositions
    rows = []
    cid = 0
    for n in range(2, max_n + 1):
        for comp in compositions(n):
            for a, l in comp:
                rows.append(f"({n}, {cid}, {a}, {l})")
            cid += 1
    return (words_ctes("dw", "pc", ["doc_id"], "pieces")
            + ngrams_cte("dg", "dw", ["doc_id"], range(1, max_n + 1), same_part=False) + f""",
gram_counts AS (SELECT n, text, count(*) AS count FROM dg GROUP BY n, text),
total AS (SELECT sum(count)::DOUBLE AS total FROM gram_counts WHERE n = 1),
cand AS (SELECT * FROM gram_counts WHERE n >= 2 AND count >= {min_count}),
comps(n, cid, a, l) AS (VALUES {', '.join(rows)}),
sub AS (SELECT c.n, c.text, c.count, p.cid, p.l,
               array_to_string(string_split(c.text, ' ')[p.a + 1 : p.a + p.l], ' ') AS sub
        FROM cand c JOIN comps p ON p.n = c.n),
segs AS (SELECT s.n, s.text, s.count, s.cid,
                sum(ln(g.count::DOUBLE) - ln(t.total)) AS lp
         FROM sub s JOIN gram_counts g ON g.n = s.l AND g.text = s.sub
         CROSS JOIN total t
         GROUP BY s.n, s.text, s.count, s.cid),
mined AS (SELECT s.text AS phrase, s.n::INTEGER AS n, s.count::BIGINT AS count,
                 (ln(s.count::DOUBLE) - ln(t.total)) - max(s.lp) AS score
          FROM segs s CROSS JOIN total t GROUP BY s.text, s.n, s.count, t.total)""")


def tokens_cte(src: str = "chunks") -> str:
    """ids -> piece strings via the vocabulary (specials and sentinels included); ``txt`` is what decoding gives
    (single bytes are characters below 128; the shared tables' texts need no others)."""
    return f""",
full_vocab AS (SELECT piece, id, piece AS txt FROM vocab UNION ALL SELECT '<pad>', 0, '' UNION ALL SELECT '</s>', 1, ''
               UNION ALL SELECT '<unk>', 2, ''
               UNION ALL SELECT '<0x' || upper(printf('%02x', b)) || '>', (3 + b)::INTEGER, CASE WHEN b < 128 THEN chr(b::INTEGER) END
               FROM range(256) t(b)
               UNION ALL SELECT '<extra_id_' || CAST(j AS VARCHAR) || '>', (32099 - j)::INTEGER, '' FROM range(100) t(j)),
tk_u AS (SELECT doc_id, chunk, unnest(input_ids) AS id, unnest(generate_series(1, len(input_ids))) AS pos FROM {src}),
tk_rows AS (SELECT c.doc_id, c.chunk, c.row_key, c.input_ids, c.attention_mask,
                   list(coalesce(v.piece, '<unk>') ORDER BY u.pos) AS tokens
            FROM {src} c JOIN tk_u u ON u.doc_id = c.doc_id AND u.chunk = c.chunk
            LEFT JOIN full_vocab v ON v.id = u.id
            GROUP BY c.doc_id, c.chunk, c.row_key, c.input_ids, c.attention_mask)"""


def phrase_mask_ctes(p: float = 0.5, max_pred: int = 512) -> str:
    """E5-E7 over ``tk_rows`` with words ``cw`` and phrase set ``mined_set``: table ``pmask``."""
    budget = f"least({max_pred}, greatest(1, round_even(len(r.tokens) * {p!r}, 0)::INTEGER))"
    return (ngrams_cte("cg", "cw", ["doc_id", "chunk"], (5, 4, 3, 2)) + f""",
cm AS (SELECT g.* FROM cg g WHERE g.text IN (SELECT phrase FROM mined_set)),
cr AS (SELECT r.doc_id, r.chunk,
              list_reduce(coalesce(list({{'s': m.s, 'n': m.n}} ORDER BY m.n DESC, {md5('r.row_key', "'merge'", 'm.n', 'm.s')})
                                   FILTER (WHERE m.s IS NOT NULL), []),
                          lambda acc, x: CASE WHEN len(list_filter(acc, lambda a: a.s < x.s + x.n AND x.s < a.s + a.n)) > 0
                                              THEN acc ELSE list_append(acc, x) END,
                          []::STRUCT(s BIGINT, n INTEGER)[]) AS chosen
       FROM tk_rows r LEFT JOIN cm m ON m.doc_id = r.doc_id AND m.chunk = r.chunk GROUP BY r.doc_id, r.chunk, r.row_key),
ch AS (SELECT doc_id, chunk, unnest(chosen) AS c FROM cr),
ch2 AS (SELECT doc_id, chunk, c.s AS s, c.n AS n FROM ch),
pcand AS (
  SELECT h.doc_id, h.chunk, w1.first AS first, (w2.first + w2.ntok - w1.first) AS ntok
  FROM ch2 h JOIN cw w1 ON w1.doc_id = h.doc_id AND w1.chunk = h.chunk AND w1.w = h.s
             JOIN cw w2 ON w2.doc_id = h.doc_id AND w2.chunk = h.chunk AND w2.w = h.s + h.n - 1
  UNION ALL
  SELECT w.doc_id, w.chunk, w.first, w.ntok FROM cw w
  WHERE NOT EXISTS (SELECT 1 FROM ch2 h WHERE h.doc_id = w.doc_id AND h.chunk = w.chunk AND w.w >= h.s AND w.w < h.s + h.n)),
sel AS (
  SELECT r.doc_id, r.chunk,
         list_reduce(coalesce(list({{'first': c.first, 'ntok': c.ntok}} ORDER BY c.ntok DESC, {md5('r.row_key', "'cand'", 'c.first')})
                              FILTER (WHERE c.first IS NOT NULL), []),
                     lambda acc, x: CASE WHEN acc.used + x.ntok <= {budget}
                                         THEN {{'used': acc.used + x.ntok, 'sel': list_append(acc.sel, x)}} ELSE acc END,
                     {{'used': 0, 'sel': []::STRUCT(first BIGINT, ntok BIGINT)[]}}).sel AS sel
  FROM tk_rows r LEFT JOIN pcand c ON c.doc_id = r.doc_id AND c.chunk = r.chunk
  GROUP BY r.doc_id, r.chunk, r.row_key, r.tokens),
pmask AS (
  SELECT r.*, list_transform(range(len(r.tokens)), lambda i:
           CASE WHEN len(list_filter(s.sel, lambda c: i >= c.first AND i < c.first + c.ntok)) > 0 THEN 1 ELSE 0 END) AS mask
  FROM tk_rows r JOIN sel s ON s.doc_id = r.doc_id AND s.chunk = r.chunk)""")


def predictions_cte() -> str:
    """Oracle twin of plans.evaluation.predictions (needs ``chunks``)."""
    alt = (f"list_transform(input_ids, lambda x, i: CASE WHEN x > 1 AND {uniform('5', 'row_key', 'i - 1')} = 0 "
           f"THEN 3 + (x * 31 + (i - 1)) % 97 ELSE x END)")
    return f""",
pr0 AS (SELECT doc_id, chunk, row_key, input_ids,
               CASE WHEN {uniform('4', 'row_key')} = 0 THEN input_ids ELSE {alt} END AS alt FROM chunks),
preds AS (SELECT doc_id, chunk, row_key, [0] || alt[1 : len(alt) - 1] AS pred,
                 list_transform(input_ids, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END) AS labels FROM pr0)"""


def logits_cte() -> str:
    return f""",
lg0 AS (SELECT vec_id, embedding, CASE WHEN {uniform('8', 'vec_id')} = 0 THEN -100 ELSE label END AS label,
               vec_id // 8 AS example_key FROM embeddings),
logit_ex AS (SELECT example_key, list(embedding ORDER BY vec_id) AS logits, list(label ORDER BY vec_id) AS labels
             FROM lg0 GROUP BY example_key)"""


def stem_ctes(words: str) -> str:
    """``stemmed`` (word, stem) of the distinct words of the table ``words`` (column word), by the Porter
    algorithm with the common toolkit's extensions; words of up to three characters stay."""
    c, v = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
    m0, m1, m2 = f"^({c})?{v}{c}", f"^({c})?{v}{c}({v})?$", f"^({c})?{v}{c}{v}{c}"
    short = "[^aeiou][aeiouy][^aeiouwxy]$|^[aeiouy][^aeiou]$"

    def head(n: int, w: str = "w") -> str:
        return f"left({w}, length({w}) - {n})"

    def rules(pairs, test: str) -> str:
        cases = []
        for end, put in pairs:
            h = head(len(end))
            tested = h + (" || 'l'" if end == "logi" else "")
            cases.append(f"WHEN ends_with(w, '{end}') THEN CASE WHEN regexp_matches({tested}, '{test}') THEN {h} || '{put}' ELSE w END")
        return f"CASE {' '.join(cases)} ELSE w END"

    def trimmed(h: str) -> str:
        last, before = f"right({h}, 1)", f"right(left({h}, length({h}) - 1), 1)"
        return (f"CASE WHEN regexp_matches({h}, '(at|bl|iz)$') THEN {h} || 'e' "
                f"WHEN length({h}) > 1 AND {last} = {before} AND NOT regexp_matches({h}, '[aeiou]$|[aeiou]yy$|^[yY]y$') "
                f"THEN CASE WHEN {last} IN ('l', 's', 'z') THEN {h} ELSE left({h}, length({h}) - 1) END "
                f"WHEN regexp_matches({h}, '{m1}') AND regexp_matches({h}, '{short}') THEN {h} || 'e' ELSE {h} END")
    second = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"),
              ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
              ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
              ("fulli", "ful"), ("logi", "log")]
    third = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
    fourth = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
    odd = {"sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning",
           "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe",
           "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}
    cut4 = " ".join(f"WHEN ends_with(w, '{e}') THEN CASE WHEN regexp_matches({head(len(e))}, '{m2}')"
                    + (f" AND right({head(3)}, 1) IN ('s', 't')" if e == "ion" else "") + f" THEN {head(len(e))} ELSE w END" for e in fourth)
    return f"""
st0 AS (SELECT DISTINCT word, CASE WHEN starts_with(word, 'y') THEN 'Y' || substr(word, 2) ELSE word END AS w FROM {words}),
st1 AS (SELECT word, CASE WHEN ends_with(w, 'ies') AND length(w) = 4 THEN {head(1)} WHEN ends_with(w, 'sses') THEN {head(2)}
  WHEN ends_with(w, 'ies') THEN {head(2)} WHEN ends_with(w, 'ss') THEN w WHEN ends_with(w, 's') THEN {head(1)} ELSE w END AS w FROM st0),
st2 AS (SELECT word, CASE WHEN ends_with(w, 'ied') THEN CASE WHEN length(w) = 4 THEN {head(1)} ELSE {head(2)} END
  WHEN ends_with(w, 'eed') THEN CASE WHEN regexp_matches({head(3)}, '{m0}') THEN {head(1)} ELSE w END
  WHEN ends_with(w, 'ed') AND regexp_matches({head(2)}, '^({c})?[aeiouy]') THEN {trimmed(head(2))}
  WHEN ends_with(w, 'ing') AND regexp_matches({head(3)}, '^({c})?[aeiouy]') THEN {trimmed(head(3))} ELSE w END AS w FROM st1),
st3 AS (SELECT word, CASE WHEN length(w) > 2 AND regexp_matches(w, '[^aeiouy]y$|[aeiouy]yy$') THEN {head(1)} || 'i' ELSE w END AS w FROM st2),
st4 AS (SELECT word, CASE WHEN ends_with(w, 'alli') AND regexp_matches({head(4)}, '{m0}') THEN {head(2)} ELSE w END AS w FROM st3),
st5 AS (SELECT word, {rules(second, m0)} AS w FROM st4),
st6 AS (SELECT word, {rules(third, m0)} AS w FROM st5),
st7 AS (SELECT word, CASE {cut4} ELSE w END AS w FROM st6),
st8 AS (SELECT word, CASE WHEN ends_with(w, 'e') AND (regexp_matches({head(1)}, '{m2}')
  OR (regexp_matches({head(1)}, '{m1}') AND NOT regexp_matches({head(1)}, '{short}'))) THEN {head(1)} ELSE w END AS w FROM st7),
st9 AS (SELECT word, CASE WHEN ends_with(w, 'll') AND regexp_matches({head(1)}, '{m2}') THEN {head(1)} ELSE w END AS w FROM st8),
stemmed AS (SELECT word, CASE WHEN length(word) <= 3 THEN word
  {" ".join(f"WHEN word = '{a}' THEN '{b}'" for a, b in odd.items())}
  WHEN starts_with(word, 'y') THEN 'y' || substr(w, 2) ELSE w END AS stem FROM st9)"""
