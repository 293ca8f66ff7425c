"""SQL for DuckDB that states each query of the catalogue again, from the same fixed values."""

from __future__ import annotations

from verbaline.functions import rules, tags
from verbaline.functions.text import RUN, SPACE, WEB_TOKEN


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(items: list[str]) -> str:
    """Alternatives that match the strings themselves."""
    return "|".join("".join(f"\\x{{{ord(c):X}}}" for c in s) for s in items)


def cls(chars: str) -> str:
    return "".join(f"\\x{{{ord(c):X}}}" for c in dict.fromkeys(chars))


WEB = f"web AS (SELECT doc_id, unnest(range(len(t))) AS tok_idx, unnest(t) AS token FROM (SELECT doc_id, regexp_extract_all(lower(text), {q(WEB_TOKEN)}) AS t FROM documents))"


def vocab(source: str, name: str = "vocab") -> str:
    return f"{name} AS (SELECT token AS word, row_number() OVER (ORDER BY token) + 1 AS word_id FROM (SELECT DISTINCT token FROM {source}) UNION ALL SELECT '<PAD>', 0 UNION ALL SELECT '<UNK>', 1)"


def pick(index: str, values: list[str]) -> str:
    return f"([{', '.join(map(q, values))}])[({index})::INT + 1]"


LABEL, DEP = "((tok_idx + length(token)) % 50)", "((doc_id + tok_idx // 50 + length(token)) % 46)"
LABELS, BASE = [t for t, _ in tags.LABELS], [u for _, u in tags.LABELS]
ANN = f"{WEB}, ann AS (SELECT *, {LABEL}::INT AS label_idx, {DEP}::INT AS dep_id, {pick(LABEL, LABELS)} AS tag, {pick(DEP, tags.DEPS)} AS dep FROM web)"
VERBS = ", ".join(map(q, tags.VERBS))
RES = f"""{ANN}, res AS (SELECT *, CASE WHEN tag IN ({VERBS}) AND dep IN ('AUX', 'AUXPASS') THEN 'AUX'
  WHEN tag IN ('DT', 'WDT') AND dep NOT IN ('DET', 'QUANTMOD') THEN 'PRON' ELSE {pick("label_idx", BASE)} END AS upos FROM ann)"""
WH = ", ".join(map(q, tags.WH))
CTX = f"""{RES}, ctx AS (SELECT *, lead(dep) OVER w AS nd, lag(upos, 1) OVER w AS p1, lag(upos, 2) OVER w AS p2 FROM res WINDOW w AS (PARTITION BY doc_id ORDER BY tok_idx)),
c2 AS (SELECT *, tok_idx <= 1 OR coalesce(p1 = 'PUNCT', false) OR coalesce(p2 = 'PUNCT', false) AS st, tag IN ({WH}) AND upos <> 'DET' AS wh, coalesce(nd = 'AUX', false) AS aux FROM ctx)"""

# The rule tokenizer, chunk by chunk: affixes in a recursive query, infixes place by place. RE2 has no look-around, so each rule is stated with its surroundings.
_P = rx(["§", "%", "=", "—", "–"]) + "|" + rx(rules.PUNCTS) + r"|\.\.+|\x{2026}|" + rx(rules.QUOTES[: rules.QUOTES.index("")])
_S = rx(rules.PUNCTS) + r"|\.\.+|\x{2026}|" + rx([x for x in rules.QUOTES if x] + rules.POSSESSIVE + ["—", "–"])
_DOT = "[0-9a-z" + cls("%²-+|(?:)" + "".join(rules.PUNCTS + rules.QUOTES)) + r"]\.$"
_FRONT = f"CASE WHEN starts_with(core, '+') THEN CASE WHEN regexp_matches(core, '^\\+[0-9]') THEN 0 ELSE 1 END ELSE length(regexp_extract(core, {q(f'^(?:{_P})')})) END"
_BACK = f"""greatest(length(regexp_extract(rest, {q(f"(?:{_S})$")})), CASE WHEN regexp_matches(rest, '[0-9]\\+$') OR regexp_matches(rest, {q(_DOT)})
  OR regexp_matches(rest, '\\x{{B0}}[FfCcKk]\\.$') OR regexp_matches(rest, '[A-Z][A-Z]\\.$') THEN 1 ELSE 0 END, length(regexp_extract(rest, {q(f"[0-9]({rx(rules.CURRENCY)})$")}, 1)))"""
_Q = cls("".join(rules.QUOTES))


def _hyphen() -> str:
    arms = " ".join(f"WHEN substr(core, i, {len(h)}) = {q(h)} AND regexp_matches(substr(core, i + {len(h)}, 1), '[A-Za-z]') THEN {len(h)}" for h in rules.HYPHENS)
    return f"CASE {arms} ELSE 0 END"


_INFIX = f"""CASE WHEN substr(core, i, 2) = '..' THEN length(regexp_extract(substr(core, i), '^\\.+'))
  WHEN c = chr(8230) THEN 1
  WHEN regexp_matches(b, '[0-9]') AND regexp_matches(c, '[+\\-*^]') AND regexp_matches(a, '[0-9-]') THEN 1
  WHEN regexp_matches(b, '[a-z{_Q.replace("'", "''")}]') AND c = '.' AND regexp_matches(a, '[A-Z{_Q.replace("'", "''")}]') THEN 1
  WHEN regexp_matches(b, '[A-Za-z]') AND c = ',' AND regexp_matches(a, '[A-Za-z]') THEN 1
  WHEN regexp_matches(b, '[A-Za-z0-9]') AND {_hyphen()} > 0 THEN {_hyphen()}
  WHEN regexp_matches(b, '[A-Za-z0-9]') AND regexp_matches(c, '[:<>=/]') AND regexp_matches(a, '[A-Za-z]') THEN 1 ELSE 0 END"""


def peeled(source: str) -> str:
    """chunk, front, core, back (list of suffixes in text order) for the chunks of a source."""
    return f"""peel0 AS (SELECT DISTINCT chunk FROM {source}),
peel AS (WITH RECURSIVE r(chunk, core, front, back, going) AS (
  SELECT chunk, chunk, []::VARCHAR[], []::VARCHAR[], true FROM peel0
  UNION ALL
  SELECT chunk, substr(rest, 1, (length(rest) - s)::BIGINT), CASE WHEN p > 0 THEN list_append(front, substr(core, 1, p::BIGINT)) ELSE front END,
    CASE WHEN s > 0 THEN list_prepend(substr(rest, (length(rest) - s + 1)::BIGINT), back) ELSE back END, p + s > 0
  FROM (SELECT *, {_BACK} AS s FROM (SELECT *, substr(core, (p + 1)::BIGINT) AS rest FROM (SELECT *, {_FRONT} AS p FROM r WHERE going AND core <> '')))
) SELECT chunk, core, front, back FROM r QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY length(core), going) = 1)"""


def pieces(source: str) -> str:
    """chunk, toks: its tokens. Infix matches are taken from left to right, each after the end of the one before."""
    return f"""{peeled(source)},
at0 AS (SELECT chunk, core, unnest(range(1, length(core) + 1)) AS i FROM peel WHERE core <> '' AND NOT contains(core, 'http://') AND regexp_matches(core, '[^A-Za-z0-9]')),
at1 AS (SELECT chunk, core, i, substr(core, i, 1) AS c, CASE WHEN i > 1 THEN substr(core, i - 1, 1) ELSE '' END AS b, substr(core, i + 1, 1) AS a FROM at0),
at2 AS (SELECT chunk, core, i, {_INFIX} AS n FROM at1),
hits AS (SELECT chunk, core, list(struct_pack(i := i, n := n) ORDER BY i) AS m FROM at2 WHERE n > 0 GROUP BY chunk, core),
walk AS (WITH RECURSIVE w(chunk, core, m, k, done, toks) AS (
  SELECT chunk, core, m, 1, 1::BIGINT, []::VARCHAR[] FROM hits
  UNION ALL
  SELECT chunk, core, m, k + 1, CASE WHEN m[k].i >= done THEN m[k].i + m[k].n ELSE done END,
    CASE WHEN m[k].i < done THEN toks ELSE list_concat(toks, list_filter([substr(core, done, m[k].i - done), substr(core, m[k].i, m[k].n::BIGINT)], lambda x: x <> '')) END
  FROM w WHERE k <= len(m)
) SELECT chunk, list_filter(list_append(toks, substr(core, done)), lambda x: x <> '') AS toks FROM w WHERE k > len(m)),
cut AS (SELECT p.chunk, list_concat(list_concat(front, coalesce(w.toks, CASE WHEN core <> '' THEN [core] ELSE []::VARCHAR[] END)), back) AS toks FROM peel p LEFT JOIN walk w USING (chunk))"""


def rule(table: str, key: str, text: str) -> str:
    """rt: key, tok_idx, start, end, spacy, token."""
    return f"""r0 AS (SELECT {key}, unnest(range(len(r))) AS k, unnest(r) AS run FROM (SELECT {key}, regexp_extract_all({text}, {q(RUN)}) AS r FROM {table})),
r1 AS (SELECT *, coalesce(sum(length(run)) OVER (PARTITION BY {key} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s, coalesce(starts_with(lead(run) OVER (PARTITION BY {key} ORDER BY k), ' '), false) AS sp FROM r0),
r2 AS (SELECT {key}, k, sp, CASE WHEN k > 0 AND starts_with(run, ' ') THEN s + 1 ELSE s END AS s, CASE WHEN k > 0 AND starts_with(run, ' ') THEN substr(run, 2) ELSE run END AS chunk FROM r1),
r3 AS (SELECT * FROM r2 WHERE chunk <> ''),
{pieces("r3")},
t0 AS (SELECT {key}, k, sp, s, len(toks) AS n, unnest(range(len(toks))) AS j, unnest(toks) AS token FROM r3 JOIN cut USING (chunk)),
rt AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY k, j) - 1 AS tok_idx,
  (s + coalesce(sum(length(token)) OVER (PARTITION BY {key}, k ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start, sp AND j = n - 1 AS spacy, token FROM t0)"""


RT = rule("documents", "doc_id", "text")
BYTES = f"{RT}, bo AS (SELECT *, coalesce(sum(strlen(token) + spacy::INT) OVER (PARTITION BY doc_id ORDER BY tok_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sb FROM rt)"


def le32(x: str) -> str:
    h = f"lpad(hex(({x})::BIGINT), 8, '0')"
    return f"({' || '.join(f'substr({h}, {i}, 2)' for i in (7, 5, 3, 1))})"


M32, ALL64, ALL32 = "1540483477", "18446744073709551616", "4294967296"
M64 = str(0xC6A4A7935BD1E995)


def mul(a: str, m: str, mod: str, kind: str) -> str:
    return f"((({a})::UHUGEINT * {m}) % {mod})::{kind}"


def m64(a: str) -> str:
    return mul(a, M64, ALL64, "UBIGINT")


def m32(a: str) -> str:
    return f"((({a})::UBIGINT * {M32}) % {ALL32})::UBIGINT"


def mixed64(k: str) -> str:
    one = m64(k)
    return m64(f"xor({one}, {one} >> 47)")


def mixed32(k: str) -> str:
    one = m32(k)
    return m32(f"xor({one}, {one} >> 24)")


def block(width: int, i: str) -> str:
    """Number i (from 0) of the little-endian blocks of hx, cut off at its end."""
    byte = lambda j: f"(CASE WHEN 2 * ({i} * {width} + {j}) < length(hx) THEN ('0x' || substr(hx, (2 * ({i} * {width} + {j}) + 1)::BIGINT, 2))::UBIGINT ELSE 0::UBIGINT END * {256**j}::UBIGINT)"
    return "(" + " + ".join(byte(j) for j in range(width)) + ")"


HASH = f"{WEB}, w0 AS (SELECT DISTINCT token AS word FROM web), w1 AS (SELECT word, hex(encode(word)) AS hx, strlen(word)::UBIGINT AS n FROM w0)"


def fold(start: str, blocks: str, step: str) -> str:
    return f"list_reduce(list_prepend({start}, {blocks}), lambda h, k: {step})"


def murmur64a(head: str = HASH) -> str:
    """word, hash, hash_unsigned of the words of w1 (word, its bytes hx in hex, their number n)."""
    bl = f"list_transform(range((n // 8)::BIGINT), lambda i: {block(8, 'i')})"
    body = fold(f"xor(1::UBIGINT, {m64('n')})", bl, m64(f"xor(h, {mixed64('k')})"))
    tail = f"CASE WHEN n % 8 > 0 THEN {m64('xor(h, ' + block(8, '(n // 8)::BIGINT') + ')')} ELSE h END"
    return f"""WITH {head}, a AS (SELECT word, hx, n, {body} AS h FROM w1), b AS (SELECT word, {tail} AS h FROM a), c AS (SELECT word, {m64('xor(h, h >> 47)')} AS h FROM b), d AS (SELECT word, xor(h, h >> 47) AS h FROM c)
SELECT word, (CASE WHEN h >= 9223372036854775808 THEN h::HUGEINT - {ALL64} ELSE h::HUGEINT END)::BIGINT AS hash, h::VARCHAR AS hash_unsigned FROM d"""


FIN32 = f"c AS (SELECT word, {m32('xor(h, h >> 13)')} AS h FROM b) SELECT word, xor(h, h >> 15)::BIGINT AS hash FROM c"


def murmur2() -> str:
    bl = f"list_transform(range((n // 4)::BIGINT), lambda i: {block(4, 'i')})"
    body = fold("xor(1::UBIGINT, n)", bl, f"xor({m32('h')}, {mixed32('k')})")
    tail = f"CASE WHEN n % 4 > 0 THEN {m32('xor(h, ' + block(4, '(n // 4)::BIGINT') + ')')} ELSE h END"
    return f"WITH {HASH}, a AS (SELECT word, hx, n, {body} AS h FROM w1), b AS (SELECT word, {tail} AS h FROM a), {FIN32}"


def murmur2a(head: str = HASH) -> str:
    """The tail, a zero if there is none, and the length are blocks like the others."""
    bl = f"list_append(list_append(list_transform(range((n // 4)::BIGINT), lambda i: {block(4, 'i')}), CASE WHEN n % 4 > 0 THEN {block(4, '(n // 4)::BIGINT')} ELSE 0::UBIGINT END), n)"
    return f"WITH {head}, b AS (SELECT word, {fold('1::UBIGINT', bl, f'xor({m32("h")}, {mixed32("k")})')} AS h FROM w1), {FIN32}"


def murmur64b() -> str:
    lane = lambda which: f"list_transform(list_filter(range((n // 4)::BIGINT), lambda i: {which}), lambda i: {block(4, 'i')})"
    step = f"xor({m32('h')}, {mixed32('k')})"
    one = fold("xor(1::UBIGINT, n)", lane("i >= (n // 8)::BIGINT * 2 OR i % 2 = 0"), step)
    two = fold("0::UBIGINT", lane("i < (n // 8)::BIGINT * 2 AND i % 2 = 1"), step)
    tail = f"CASE WHEN n % 4 > 0 THEN {m32('xor(h2, ' + block(4, '(n // 4)::BIGINT') + ')')} ELSE h2 END"
    ends, prev = [], "b"
    for k, (to, frm, r) in enumerate((("h1", "h2", 18), ("h2", "h1", 22), ("h1", "h2", 17), ("h2", "h1", 19))):
        ends.append(f"e{k} AS (SELECT word, {m32(f'xor({to}, {frm} >> {r})')} AS {to}, {frm} FROM {prev})")
        prev = f"e{k}"
    return f"""WITH {HASH}, a AS (SELECT word, hx, n, {one} AS h1, {two} AS h2 FROM w1), b AS (SELECT word, h1, {tail} AS h2 FROM a), {", ".join(ends)},
f AS (SELECT word, h1::UHUGEINT * {ALL32} + h2 AS h FROM {prev})
SELECT word, (CASE WHEN h >= 9223372036854775808 THEN h::HUGEINT - {ALL64} ELSE h::HUGEINT END)::BIGINT AS hash, h::VARCHAR AS hash_unsigned FROM f"""


# The whole-number net.
STEP_RATE = 100.0


def _e(w: str, j: int) -> str:
    return f"coalesce({w} * {j + 1} % 5 - 2, 0)"


def _h(f: int) -> str:
    terms = [f"({(f + 2 * d + 3 * k) % 3 - 1}) * {_e(w, d)}" for k, w in enumerate(("l", "word_id", "r")) for d in range(4)]
    return f"greatest(0, {f - 1} + {' + '.join(terms)})"


def _z(t: int) -> str:
    return f"({t % 2} + {' + '.join(f'({(2 * t + f) % 3 - 1}) * h{f}' for f in range(3))})::BIGINT"


NET = f"""{WEB}, {vocab("web")},
e AS (SELECT doc_id, tok_idx, token, word_id FROM web JOIN vocab ON token = word),
n0 AS (SELECT *, lag(word_id) OVER w AS l, lead(word_id) OVER w AS r FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY tok_idx)),
n1 AS (SELECT doc_id, tok_idx, CASE WHEN tok_idx % 10 = 9 THEN -1 ELSE (tok_idx + length(token)) % 5 END::BIGINT AS label, {', '.join(f'{_h(f)} AS h{f}' for f in range(3))} FROM n0),
net AS (SELECT doc_id, tok_idx, label, [{', '.join(_z(t) for t in range(5))}] AS z FROM n1),
pred AS (SELECT *, list_position(z, list_max(z)) - 1 AS pred, doc_id // 32 AS batch_id FROM net),
loss AS (SELECT batch_id, ln(list_sum(list_transform(z, lambda v: exp(v - list_max(z))))) + list_max(z) - z[label::INT + 1] AS loss FROM pred WHERE label >= 0)"""



def _step() -> str:
    """The net of NET after one step down the mean gradient: softmax less the label, back through each layer."""
    w = lambda t, f: (2 * t + f) % 3 - 1
    c = lambda f, d, k: (f + 2 * d + 3 * k) % 3 - 1
    dh = lambda f: f"(CASE WHEN h{f} > 0 THEN {' + '.join(f'd{t} * ({w(t, f)})' for t in range(5))} ELSE 0 END)"
    of = {0: "l", 1: "word_id", 2: "r"}
    layers = [("fc.bias", t, t % 2, f"d{t}") for t in range(5)] + [("fc.weight", 3 * t + f, w(t, f), f"d{t} * h{f}") for t in range(5) for f in range(3)]
    layers += [("conv.bias", f, f - 1, f"g{f}") for f in range(3)] + [("conv.weight", 12 * f + 3 * d + k, c(f, d, k), f"g{f} * {_e(of[k], d)}") for f in range(3) for d in range(4) for k in range(3)]
    one = [f"SELECT {q(n)} AS name, -1::BIGINT AS word_id, {i} AS pos, {old} - {STEP_RATE} * sum({x}) / any_value(n) AS value FROM b2" for n, i, old, x in layers]
    per = [f"SELECT {of[k]} AS word_id, {d} AS pos, {' + '.join(f'g{f} * ({c(f, d, k)})' for f in range(3))} AS g, n FROM b2 WHERE {of[k]} IS NOT NULL" for k in range(3) for d in range(4)]
    return f"""WITH {NET}, b0 AS (SELECT n0.*, n1.label, h0, h1, h2, z, count(*) OVER () AS n FROM n0 JOIN n1 USING (doc_id, tok_idx) JOIN net USING (doc_id, tok_idx) WHERE n1.label >= 0),
b1 AS MATERIALIZED (SELECT *, {', '.join(f"exp(z[{t + 1}] - list_max(z)) / list_sum(list_transform(z, lambda v: exp(v - list_max(z)))) - (label = {t})::INT AS d{t}" for t in range(5))} FROM b0),
b2 AS MATERIALIZED (SELECT *, {', '.join(f'{dh(f)} AS g{f}' for f in range(3))} FROM b1),
per AS (SELECT word_id, pos, sum(g) / any_value(n) AS g FROM ({' UNION ALL '.join(per)}) GROUP BY word_id, pos)
SELECT name, word_id, pos::BIGINT AS pos, round(value, 6) + 0.0::DOUBLE AS value FROM ({' UNION ALL '.join(one)}
UNION ALL SELECT 'embedding', v.word_id, d, v.word_id * (d + 1) % 5 - 2 - {STEP_RATE} * coalesce(per.g, 0) FROM vocab v, range(4) a(d) LEFT JOIN per ON per.word_id = v.word_id AND per.pos = d
UNION ALL SELECT 'loss', -1, 0, avg(ln(list_sum(list_transform(z, lambda v: exp(v - list_max(z))))) + list_max(z) - z[label::INT + 1]) FROM b1)"""


def _served() -> str:
    z = lambda t: f"({_z(t)} - {t % 2} + ({t} + ver - 1) % 2)"
    known = "(SELECT unnest(words) AS token FROM m WHERE conv_id % 5 <> 0)"
    return f"""WITH m AS (SELECT row_number() OVER () AS id, conv_id, conv_id::VARCHAR || ':' || turn::VARCHAR AS request_id, text, 1 + conv_id % 2 AS ver, regexp_extract_all(lower(text), {q(WEB_TOKEN)}) AS words,
  CASE WHEN turn = 1 AND conv_id % 7 <> 3 THEN 'LOAD' WHEN (conv_id + turn) % 11 = 10 THEN 'PING' ELSE 'INFER' END AS kind FROM conversations),
a AS MATERIALIZED (SELECT * FROM m WHERE kind = 'LOAD' OR kind = 'INFER' AND conv_id IN (SELECT conv_id FROM m WHERE kind = 'LOAD')), {vocab(known)},
t AS (SELECT id, ver, unnest(range(len(words))) AS tok_idx, unnest(words) AS token FROM a WHERE kind = 'INFER'),
e AS (SELECT id, ver, tok_idx, coalesce(word_id, 1) AS word_id FROM t LEFT JOIN vocab ON token = word),
n0 AS (SELECT *, lag(word_id) OVER w AS l, lead(word_id) OVER w AS r FROM e WINDOW w AS (PARTITION BY id ORDER BY tok_idx)),
n1 AS (SELECT id, ver, tok_idx, {', '.join(f'{_h(f)} AS h{f}' for f in range(3))} FROM n0),
n2 AS (SELECT id, tok_idx, [{', '.join(z(t) for t in range(5))}] AS z FROM n1),
n3 AS (SELECT id, string_agg({pick('list_position(z, list_max(z)) - 1', tags.SHIPPED[:5])}, ' ' ORDER BY tok_idx) AS tags FROM n2 GROUP BY id)
SELECT request_id, CASE WHEN kind = 'LOAD' THEN 'READY' WHEN text IS NULL THEN 'ERROR' ELSE 'RESULT' END AS type, CASE WHEN kind = 'INFER' THEN array_to_string(words, ' ') END AS words,
  CASE WHEN kind = 'INFER' AND text IS NOT NULL THEN coalesce(n3.tags, '') END AS tags, CASE WHEN kind = 'INFER' AND text IS NULL THEN 'no text' END AS error FROM a LEFT JOIN n3 USING (id)"""


TURNS = f"turns AS (SELECT conv_id * 1000 + turn AS sent_id, unnest(range(len(t))) AS tok_idx, unnest(t) AS token FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), {q(WEB_TOKEN)}) AS t FROM conversations))"
INFER = f"""inf AS (SELECT conv_id::VARCHAR || ':' || turn::VARCHAR AS request_id, text, regexp_extract_all(lower(text), {q(WEB_TOKEN)}) AS words FROM conversations),
tagged AS (SELECT *, list_transform(words, lambda w: ([{', '.join(map(q, LABELS))}])[(length(w) % 50)::INT + 1]) AS tags FROM inf)"""


PARTS = f"w0 AS (SELECT conv_id * 1000 + turn AS word, array_to_string(regexp_extract_all(lower(text), {q(WEB_TOKEN)}), '') AS j FROM conversations), w1 AS (SELECT word, hex(encode(j)) AS hx, strlen(j)::UBIGINT AS n FROM w0)"
LOOP = f"""{INFER.replace('SELECT conv_id::VARCHAR', 'SELECT conv_id, turn, conv_id::VARCHAR')}, loop AS (SELECT *, CASE WHEN turn % 3 = 1 THEN 'LOAD' WHEN (conv_id + turn) % 5 = 4 THEN 'PING' ELSE 'INFER' END AS kind FROM tagged),
said AS (SELECT *, kind = 'INFER' AND (text IS NULL OR len(words) % 2 = 0) AS failed FROM loop WHERE kind <> 'PING')
SELECT request_id, CASE WHEN kind = 'LOAD' THEN 'READY' WHEN failed THEN 'ERROR' ELSE 'RESULT' END AS type, CASE WHEN kind = 'INFER' AND NOT failed THEN array_to_string(tags, ' ') END AS tags,
  CASE WHEN failed THEN coalesce(len(words)::VARCHAR || ' words', 'no text') END AS error FROM said"""


def html(x: str) -> str:
    for c, e in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = f"replace({x}, {q(c)}, {q(e)})"
    return x


def queries() -> dict[str, str]:
    train, test = "(SELECT * FROM web WHERE doc_id % 5 <> 0)", "(SELECT * FROM web WHERE doc_id % 5 = 0)"
    return {
        "encode_documents": f"WITH {WEB}, {vocab('web')} SELECT doc_id, count(*) AS n_tokens, count(DISTINCT word_id) AS n_words, sum(word_id)::BIGINT AS id_sum FROM web JOIN vocab ON token = word GROUP BY doc_id",
        "web_tokens": f"WITH {WEB} SELECT doc_id, tok_idx, token FROM web",
        "web_token_counts": f"WITH {WEB} SELECT doc_id, count(*) AS n_tokens FROM web GROUP BY doc_id",
        "vocab_map": f"WITH {WEB}, {vocab('web')} SELECT word, word_id FROM vocab",
        "tag_map": f"WITH {ANN} SELECT tag, row_number() OVER (ORDER BY tag) - 1 AS tag_id FROM (SELECT DISTINCT tag FROM ann)",
        "encode_unk": f"WITH {WEB}, {vocab(train)} SELECT doc_id, tok_idx, coalesce(word_id, 1) AS word_id FROM {test} LEFT JOIN vocab ON token = word",
        "oov_words": f"WITH {WEB}, {vocab(train)} SELECT token AS word, count(*) AS n FROM {test} WHERE token NOT IN (SELECT word FROM vocab) GROUP BY token",
        "strict_tag_check": f"WITH {ANN}, tv AS (SELECT tag, row_number() OVER (ORDER BY tag) - 1 AS tag_id FROM (SELECT DISTINCT tag FROM ann WHERE doc_id % 5 <> 0)) SELECT tag, tag_id, count(*) AS n FROM ann JOIN tv USING (tag) WHERE doc_id % 5 = 0 GROUP BY tag, tag_id",
        "dataset_stats": f"WITH {ANN} SELECT count(DISTINCT doc_id) AS sentences, count(DISTINCT token) + 2 AS vocabulary, count(DISTINCT tag) AS tags, count(*) AS tokens FROM ann",
        "ws_runs": f"""WITH r0 AS (SELECT doc_id, unnest(range(len(r))) AS run_idx, unnest(r) AS run FROM (SELECT doc_id, regexp_extract_all(text, {q(RUN)}) AS r FROM documents))
SELECT doc_id, run_idx, coalesce(sum(length(run)) OVER (PARTITION BY doc_id ORDER BY run_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, run, regexp_matches(run, '^[{SPACE}]') AS is_space FROM r0""",
        "spacy_flags": f"WITH {RT} SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_spacy FROM documents d LEFT JOIN (SELECT doc_id, count(*) FILTER (spacy) AS n FROM rt GROUP BY doc_id) USING (doc_id)",
        "affix_peel": f"WITH c0 AS (SELECT unnest(regexp_extract_all(text, '[^{SPACE}]+')) AS chunk FROM documents), {peeled('c0')} SELECT chunk, array_to_string(front, chr(1)) AS prefixes, core, array_to_string(back, chr(1)) AS suffixes FROM peel",
        "rule_tokens": f'WITH {RT} SELECT doc_id, tok_idx, start, start + length(token) AS "end", spacy, token FROM rt',
        "url_rule_tokens": f'WITH {rule("pages", "page_id", "url")} SELECT page_id, tok_idx, start, start + length(token) AS "end", spacy, token FROM rt',
        "sql_functions": f"""WITH {rule("benchmark", "item_id", "text")}, h AS ({murmur64a("w0 AS (SELECT DISTINCT token AS word FROM rt), w1 AS (SELECT word, hex(encode(word)) AS hx, strlen(word)::UBIGINT AS n FROM w0)")})
SELECT item_id, tok_idx, token, hash, len(regexp_extract_all(lower(token), {q(WEB_TOKEN)}))::INT AS n_web FROM rt JOIN h ON token = word""",
        "rule_token_counts": f"WITH {RT} SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_tokens FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM rt GROUP BY doc_id) USING (doc_id)",
        "byte_offsets": f"WITH {BYTES} SELECT doc_id, tok_idx, sb AS start_byte, sb + strlen(token) AS end_byte, spacy FROM bo",
        "doc_buffer_size": f"WITH {RT} SELECT d.doc_id, (8 + strlen(text) + 12 * coalesce(n, 0))::BIGINT AS n_bytes FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM rt GROUP BY doc_id) USING (doc_id)",
        "doc_buffer_md5": f"""WITH {BYTES}, body AS (SELECT doc_id, count(*) AS n, string_agg({le32('sb')} || {le32('sb + strlen(token)')} || {le32('spacy::INT')}, '' ORDER BY tok_idx) AS hx FROM bo GROUP BY doc_id)
SELECT d.doc_id, md5(unhex({le32('strlen(text)')} || hex(encode(text)) || {le32('coalesce(n, 0)')} || coalesce(hx, ''))) AS md5 FROM documents d LEFT JOIN body USING (doc_id)""",
        "murmur64a_words": murmur64a(),
        "murmur2_words": murmur2(),
        "murmur2a_words": murmur2a(),
        "murmur64b_words": murmur64b(),
        "murmur2a_parts": f"SELECT word AS sent_id, hash FROM ({murmur2a(PARTS)})",
        "upos_base": f"WITH {ANN} SELECT tag, {pick('label_idx', BASE)} AS upos_base, count(*) AS n FROM ann GROUP BY ALL",
        "upos_resolved": f"WITH {RES} SELECT doc_id, tok_idx, tag, dep, upos FROM res",
        "upos_raw_compat": f"""WITH {ANN} SELECT label_idx, dep_id, CASE WHEN label_idx BETWEEN 38 AND 43 AND dep_id IN (9, 10) THEN 'AUX' WHEN label_idx IN (12, 44) AND dep_id NOT IN (20, 42) THEN 'PRON'
  ELSE {pick('label_idx', BASE)} END AS upos, count(*) AS n FROM ann GROUP BY ALL""",
        "upos_counts": f"WITH {RES} SELECT upos, (list_position([{', '.join(map(q, tags.UPOS))}], upos) - 1)::INT AS upos_id, count(*) AS n FROM res GROUP BY ALL",
        "noun_verb_wh_flags": f"WITH {ANN} SELECT doc_id, count(*) FILTER (tag IN ({', '.join(map(q, tags.NOUNS))})) AS nouns, count(*) FILTER (tag IN ({VERBS})) AS verbs, count(*) FILTER (tag IN ({WH})) AS wh_words FROM ann GROUP BY doc_id",
        "sentence_feats_literal": f"WITH {CTX} SELECT doc_id, count(*) FILTER (st AND NOT wh AND NOT aux) AS feats FROM c2 GROUP BY doc_id",
        "wh_question_count": f"WITH {CTX} SELECT doc_id, count(*) FILTER (st AND wh AND aux) AS wh_questions FROM c2 GROUP BY doc_id",
        "head_tokens": f"""WITH {ANN}, lists AS (SELECT doc_id, list(token ORDER BY tok_idx) AS ts, list(tag ORDER BY tok_idx) AS gs FROM ann GROUP BY doc_id)
SELECT doc_id, i AS tok_idx, ts[i // 2 + 1] AS head_token, gs[i // 2 + 1] AS head_tag FROM (SELECT doc_id, ts, gs, unnest(range(len(ts))) AS i FROM lists)""",
        "conllu_roundtrip": f"WITH {ANN} SELECT doc_id, tok_idx, token AS form, tag AS xpos FROM ann",
        "conllu_filter_ids": f"WITH {ANN} SELECT doc_id, tag AS xpos, count(*) AS n FROM ann WHERE tok_idx % 7 <> 3 AND tok_idx % 11 <> 5 GROUP BY ALL",
        "conllu_files": f"WITH {ANN} SELECT token AS form, tag AS xpos, count(*) AS n, max(tok_idx) AS last_idx FROM ann GROUP BY ALL",
        "vocab_json_roundtrip": f"WITH {WEB}, {vocab('web')} SELECT word, word_id FROM vocab",
        "tag_map_invert": f"WITH {ANN} SELECT row_number() OVER (ORDER BY tag) - 1 AS tag_id, tag FROM (SELECT DISTINCT tag FROM ann)",
        "batch_assignment": "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch_id FROM documents",
        "batch_shuffle": "SELECT doc_id, (row_number() OVER (ORDER BY ('0x' || substr(md5(doc_id::VARCHAR || ':42'), 1, 15))::BIGINT, doc_id) - 1) // 32 AS batch_id FROM documents",
        "pad_batches": f"""WITH {TURNS}, {vocab('turns')}, s AS (SELECT sent_id, list(word_id ORDER BY tok_idx) AS ids FROM turns JOIN vocab ON token = word GROUP BY sent_id),
b AS (SELECT *, (row_number() OVER (ORDER BY sent_id) - 1) // 32 AS batch_id FROM s), w AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS width FROM b)
SELECT sent_id, batch_id, array_to_string(list_concat(ids, list_transform(range(width - len(ids)), lambda i: 0::BIGINT)), ' ') AS padded FROM w""",
        "trigram_contexts": f"WITH {NET} SELECT l AS left_id, word_id AS mid_id, r AS right_id, count(*) AS n FROM n0 GROUP BY ALL",
        "conv_int_logits": f"WITH {NET} SELECT doc_id, tok_idx, array_to_string(z, ' ') AS logits FROM net",
        "argmax_first": f"WITH {NET} SELECT doc_id, tok_idx, pred::BIGINT AS tag_id FROM pred",
        "masked_accuracy": f"WITH {NET} SELECT doc_id, round(CASE WHEN count(*) FILTER (label >= 0) > 0 THEN count(*) FILTER (pred = label)::DOUBLE / count(*) FILTER (label >= 0) END, 6) AS accuracy FROM pred GROUP BY doc_id",
        "batch_mean_accuracy": f"WITH {NET}, p AS (SELECT batch_id, count(*) FILTER (pred = label) AS r, count(*) FILTER (label >= 0) AS n FROM pred GROUP BY batch_id) SELECT round(avg(r / n), 6) AS batch_mean, round(sum(r) / sum(n), 6) AS token_mean FROM p",
        "cross_entropy": f"WITH {NET} SELECT batch_id, round(avg(loss), 6) AS loss FROM loss GROUP BY batch_id",
        "epoch_loss": f"WITH {NET} SELECT round(avg(l), 6) AS epoch_loss FROM (SELECT avg(loss) AS l FROM loss GROUP BY batch_id)",
        "cnn_step": _step(),
        "served_loop": _served(),
        "decode_tags": f"WITH {NET} SELECT {pick('pred', tags.SHIPPED[:5])} AS tag, count(*) AS n FROM pred GROUP BY ALL",
        "weights_roundtrip": f"""WITH {WEB}, {vocab('web')}, v AS (SELECT count(*) AS n FROM vocab)
SELECT 'embedding' AS name, n::VARCHAR || ' 4' AS shape, n * 4 AS n, (SELECT sum(w * j % 5 - 2) FROM range(0, (SELECT n FROM v)) a(w), range(1, 5) b(j))::DOUBLE AS total FROM v
UNION ALL SELECT 'conv.weight', '3 4 3', 36, (SELECT sum((f + 2 * d + 3 * k) % 3 - 1) FROM range(3) a(f), range(4) b(d), range(3) c(k))::DOUBLE
UNION ALL SELECT 'conv.bias', '3', 3, 0.0 UNION ALL SELECT 'fc.weight', '5 3', 15, (SELECT sum((2 * t + f) % 3 - 1) FROM range(5) a(t), range(3) b(f))::DOUBLE UNION ALL SELECT 'fc.bias', '5', 5, 2.0""",
        "onnx_roundtrip": f"""WITH {WEB}, {vocab('web')}, v AS (SELECT count(*) AS n FROM vocab),
e AS (SELECT w, (w * j % 5 - 2)::DOUBLE AS x FROM range(0, (SELECT n FROM v)) a(w), range(1, 5) b(j))
SELECT 'embedding' AS name, n::VARCHAR || ' 4' AS shape, n * 4 AS n, (SELECT sum(x) FROM e) AS total, (SELECT sum(x * w) FROM e) AS by_row FROM v
UNION ALL SELECT 'conv.weight', '3 4 3', 36, (SELECT sum((f + 2 * d + 3 * k) % 3 - 1) FROM range(3) a(f), range(4) b(d), range(3) c(k))::DOUBLE, 0.0
UNION ALL SELECT 'conv.bias', '3', 3, 0.0, 0.0 UNION ALL SELECT 'fc.weight', '5 3', 15, (SELECT sum((2 * t + f) % 3 - 1) FROM range(5) a(t), range(3) b(f))::DOUBLE, 0.0 UNION ALL SELECT 'fc.bias', '5', 5, 2.0, 0.0""",
        "render_html": f"WITH {INFER} SELECT request_id, array_to_string(list_transform(list_zip(words, tags), lambda x: '<div><span>' || {html('x[1]')} || '</span><span>' || {html('x[2]')} || '</span></div>'), '') AS html FROM tagged",
        "message_loop": f"WITH {LOOP}",
        "stream_infer": f"WITH {INFER} SELECT request_id, CASE WHEN text IS NULL THEN 'ERROR' ELSE 'RESULT' END AS type, array_to_string(words, ' ') AS words, array_to_string(tags, ' ') AS tags FROM tagged",
    }
