"""DuckDB SQL of the engine's steps, from which the expected results of queries are put together.

Each function gives common table expressions for a WITH clause. Folding is ``strip_accents`` there,
which agrees with NFKD without combining marks on the letters of the test tables.
"""

from __future__ import annotations

from auditloom.functions import lexicon as L
from auditloom.functions import text as T
from auditloom.operators import semantic
from auditloom.operators.features import FEATURES, RULED
from auditloom.operators.scoring import LogisticModel
from auditloom.sources import tables


def count_of(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {L.sql_text(pattern)}))"


def documents_as_tools(text: str = "coalesce(text, '')") -> str:
    return f"SELECT source AS server, 'doc_' || doc_id AS name, {text} AS raw FROM documents"


#: The fixed tools and the documents: (server, name, raw).
ALL_TOOLS = f"{tables.TOOLS_SQL}, all_tools AS (SELECT server, name, description AS raw FROM tools UNION ALL {documents_as_tools()})"


def coded(source: str, out: str, text: str = "strip_accents(raw)") -> str:
    """``out``: the rows of ``source`` with the plain view and codes of a text; a piece of texts is coded once."""
    return f"""{out}_view AS MATERIALIZED (SELECT *, {L.sql_view(text)} AS view FROM {source}),
{out}_pieces AS MATERIALIZED (SELECT *, {L.sql_pieces('view')} AS pieces FROM {out}_view),
{out}_known AS MATERIALIZED (SELECT p, {L.sql_piece('p')} AS c FROM (SELECT DISTINCT unnest(pieces) AS p FROM {out}_pieces)),
{out}_table AS MATERIALIZED (SELECT MAP(list(p), list(c)) AS m FROM {out}_known),
{out} AS MATERIALIZED (SELECT * EXCLUDE (pieces, m), {L.sql_text(L.SENTENCE)} || array_to_string(list_transform(pieces, lambda p: m[p]), '') || {L.sql_text(L.SENTENCE)} AS codes FROM {out}_pieces, {out}_table)"""


def base64_of(text: str) -> str:
    return f"list_filter(regexp_extract_all({text}, '{T.BASE64}'), lambda b: length(b) - length(replace(b, '/', '')) <= 1 AND regexp_matches(b, '[A-Z]') AND regexp_matches(b, '[0-9]'))"


def blobs(text: str) -> str:
    return f"(len({base64_of(text)}) + {count_of(text, T.HEX)} + {count_of(text, T.PERCENT)})"


def hidden(text: str) -> str:
    runs = f"list_transform(regexp_extract_all({text}, '{T.SELECTOR_RUN}'), lambda r: length(r) - 3)"
    return f"({count_of(text, f'[{T.HIDDEN}{T.ANNOTATION}]')} + coalesce(list_sum({runs}), 0))"


def word_count(text: str) -> str:
    return rf"len(list_filter(regexp_split_to_array({text}, '\s+'), lambda w: w <> ''))"


def features(source: str, out: str) -> str:
    """``out``: the rows of ``source`` (name, raw), without schemas, with the 31 features."""
    ruled = ", ".join(f"{count_of('codes', L.RULES[n])} AS {n}" for n in RULED)
    schema = ", ".join(f"0 AS {n}" for n in FEATURES[21:26])
    return f"""{coded(source, out + '_coded')},
{out}_counts AS MATERIALIZED (SELECT *, ln(1 + length(raw)) AS log_len, ln(1 + {word_count('raw')}) AS log_words, coalesce(list_aggregate(string_split(raw, ''), 'entropy'), 0) AS entropy,
  coalesce(length(regexp_replace(raw, '[\\x00-\\x7F]', '', 'g')) / nullif(length(raw), 0), 0) AS non_ascii_ratio, {hidden('raw')} AS hidden_unicode, {count_of('raw', f'[{T.BIDI}]')} AS bidi_control,
  {blobs("(name || ' ' || raw)")} AS encoded_blob, {count_of('lower(raw)', L.MARKUP)} AS markup_injection, {count_of('raw', L.COMMENT)} AS html_comment,
  {count_of('view', L.CREDENTIALS)} AS credentials, {count_of('view', L.FS_TARGETS)} AS fs_targets, {ruled},
  {count_of('codes', L.RULES['email_target'])} + {count_of('codes', L.RULES['collector_url'])} AS hardcoded_recipient,
  {count_of('codes', L.RULES['imperatives'])} / greatest({word_count('raw')}, 1) AS imperative_density, {schema} FROM {out}_coded),
{out} AS MATERIALIZED (SELECT *, least(concealment, 1) * least(exfiltration, 2) AS conceal_x_exfil, least(credentials, 2) * least(exfiltration, 2) AS cred_x_exfil, least(fs_targets, 1) * least(exfiltration, 2) AS fs_x_exfil,
  least(cross_tool, 2) * least(urgency, 1) AS cross_x_urgency, least(hidden_recipient, 2) * greatest(exfiltration, CAST(hardcoded_recipient > 0 AS INT)) AS recipient_x_exfil FROM {out}_counts)"""


def probability(model: LogisticModel) -> str:
    parts = [f"{w} * ({n} - {m}) / {s}" for n, w, m, s in zip(model.features, model.weights, model.mean, model.std, strict=True) if w]
    return f"1 / (1 + exp(-({model.bias} + {' + '.join(parts)})))"


SIGNALS = "list_filter([" + ", ".join(f"CASE WHEN {n} > 0 THEN '{n}' END" for n in semantic.INTENT) + ", CASE WHEN credentials > 0 AND fs_targets > 0 THEN 'credentials+fs_targets' END], lambda s: s IS NOT NULL)"
MIXED = r"list_filter(regexp_extract_all(raw, '\S+'), lambda w: regexp_matches(w, '\p{Latin}') AND regexp_matches(w, '[\p{Cyrillic}\p{Greek}]'))"
POINTS = f"list_sort(list_transform(list_distinct(regexp_extract_all(raw, '[{T.HIDDEN}]')), lambda c: 'U+' || upper(to_hex(unicode(c)))))"


def match_words(name: str) -> str:
    """The text of the first match of a rule."""
    found = f"regexp_extract(codes, {L.sql_text(L.RULES[name])})"
    return f"substr(replace(view, chr(10), chr(10) || chr(10)), instr(codes, {found}) - 1, length({found}))"


def decoded(source: str, out: str) -> str:
    """``out``: (server, name, pos, raw) of the texts that the rows of ``source`` hold in encoded form."""
    padded = "rtrim(b, '=') || repeat('=', (4 - length(rtrim(b, '=')) % 4) % 4)"
    printable = f"({count_of('d', r'[^\p{C}\p{Z}]|[\n\t ]')} / nullif(length(d), 0))"
    return f"""{out}_lists AS (SELECT server, name, list_filter(list_transform(({base64_of('raw')})[1:5], lambda b: TRY(decode(from_base64({padded})))), lambda d: d IS NOT NULL AND coalesce({printable}, 0) > 0.8) AS base64,
  list_transform(regexp_extract_all(raw, '{T.PERCENT}')[1:3], lambda p: url_decode(p)) AS percent FROM {source}),
{out} AS (SELECT server, name, unnest(list_concat(base64, percent)) AS raw, unnest(range(len(base64) + len(percent))) AS pos FROM {out}_lists)"""


def semantic_findings(source: str, out: str, model: LogisticModel, threshold: float = 0.5) -> str:
    """``out``: (severity, title, server, tool, detail) of the semantic detector; ``detail`` is the matched text, if any."""
    p = probability(model)
    finding = lambda severity, title, detail="NULL": f"SELECT {severity} AS severity, '{title}: ' || name AS title, server, name AS tool, CAST({detail} AS VARCHAR) AS detail"
    claim, order = (f"regexp_matches(codes, {L.sql_text(L.RULES[n])})" for n in ("cross_server_claim", "model_directed"))
    return f"""{features(source, out + '_f')}, {decoded(source, out + '_d')}, {features(out + '_d', out + '_g')},
{out}_hits AS (SELECT server, name, min(pos) AS pos FROM (SELECT *, {p} AS p FROM {out}_g) WHERE p >= {max(threshold, semantic.DECODED_SCORE)} GROUP BY server, name),
{out}_scored AS (SELECT *, {p} AS p, {SIGNALS} AS signals FROM {out}_f),
{out} AS ({finding("CASE WHEN p >= 0.8 THEN 'high' ELSE 'medium' END", 'Description reads as orders to the model')} FROM {out}_scored ANTI JOIN {out}_hits USING (server, name) WHERE len(signals) > 0 AND p >= {threshold}
  UNION ALL {finding("'critical'", 'Encoded payload in a description')} FROM {out}_hits
  UNION ALL {finding("'critical'", 'Invisible characters in a description')} FROM {source} WHERE len({POINTS}) > 0
  UNION ALL {finding("'high'", 'Tool claims to go before other servers', match_words('cross_server_claim'))} FROM {out}_f WHERE {claim}
  UNION ALL {finding("'high'", 'Description speaks to the model', match_words('model_directed'))} FROM {out}_f WHERE {order}
  UNION ALL {finding("'high'", 'Mixed scripts within words')} FROM {source} WHERE len({MIXED}) > 0)"""


def tags(source: str, out: str) -> str:
    """``out``_tools: (server, name, caps); ``out``: (server, tool, cap)."""
    both = f"(SELECT server, name, name || ' ' || raw AS raw FROM {source})"
    caps = "[" + ", ".join(f"CASE WHEN regexp_matches(codes, {L.sql_text(p)}) THEN '{tag}' END" for tag, p in L.TAGS.items()) + "]"
    return f"""{coded(both, out + '_c', 'raw')}, {out}_tools AS MATERIALIZED (SELECT server, name, list_filter({caps}, lambda t: t IS NOT NULL) AS caps FROM {out}_c),
{out} AS MATERIALIZED (SELECT DISTINCT server, server || '.' || name AS tool, unnest(caps) AS cap FROM {out}_tools)"""


RULES = f"rules(rule, source, sink, severity) AS (VALUES {', '.join(f"({i}, '{s}', '{k}', '{v}')" for i, (s, k, v) in enumerate(L.TOXIC_PAIRS))})"


def flows(tagged: str, out: str) -> str:
    """``out``: a row for each rule and side, from all pairs."""
    return f"""{RULES}, {out}_pairs AS (SELECT rule, source, sink, severity, a.server <> b.server AS crosses, a.server AS from_server, a.tool AS from_tool, b.server AS to_server, b.tool AS to_tool
  FROM rules JOIN {tagged} a ON a.cap = source JOIN {tagged} b ON b.cap = sink WHERE a.tool <> b.tool),
{out}_best AS (SELECT *, row_number() OVER (PARTITION BY rule, crosses ORDER BY from_tool, to_tool) AS r, count(*) OVER (PARTITION BY rule, crosses) AS pairs FROM {out}_pairs),
{out} AS (SELECT rule, source, sink, crosses, CASE WHEN crosses THEN severity WHEN severity = 'critical' THEN 'high' WHEN severity = 'high' THEN 'medium' ELSE 'low' END AS severity, pairs, from_tool, to_tool FROM {out}_best WHERE r = 1)"""


def flow_findings(flows_: str) -> str:
    return f"""SELECT severity, source || ' to ' || sink || CASE WHEN crosses THEN ' across servers' ELSE ' within a server' END || ': ' || from_tool || ' and ' || to_tool AS title,
  CASE WHEN crosses THEN '*' ELSE regexp_extract(from_tool, '^(.*)\\.[^.]*$', 1) END AS server, CAST(NULL AS VARCHAR) AS tool FROM {flows_}"""


def drift(approved: str, current: str, out: str, more_servers: str = "") -> str:
    """``out``: (severity, title, server, tool) from two states (server, tool, text[, schema, notes])."""
    change = lambda severity, title, where: f"SELECT '{severity}', '{title}: ' || c.tool, c.server, c.tool FROM {current} c JOIN {approved} a USING (server, tool) WHERE {where}"
    text, other = "sha256(c.text) <> sha256(a.text)", "(c.schema <> a.schema OR c.notes <> a.notes)"
    return f"""{out}_known AS (SELECT DISTINCT server FROM {approved}), {out}_here AS (SELECT DISTINCT server FROM (SELECT server FROM {current} {more_servers})),
{out} AS (SELECT 'medium' AS severity, 'Server is not in the baseline: ' || server AS title, server, CAST(NULL AS VARCHAR) AS tool FROM {out}_here ANTI JOIN {out}_known USING (server)
  UNION ALL SELECT 'info', 'Server of the baseline is gone: ' || server, server, NULL FROM {out}_known ANTI JOIN {out}_here USING (server)
  UNION ALL SELECT 'low', 'Tool is new since the baseline: ' || tool, server, tool FROM {current} SEMI JOIN {out}_known USING (server) ANTI JOIN {approved} USING (server, tool)
  UNION ALL SELECT 'info', 'Tool of the baseline is gone: ' || tool, server, tool FROM {approved} SEMI JOIN {out}_here USING (server) ANTI JOIN {current} USING (server, tool)
  UNION ALL {change('critical', 'Description changed after approval', text)} UNION ALL {change('medium', 'Definition changed beside the description', f'NOT ({text}) AND {other}')}
  UNION ALL {change('high', 'Input schema changed after approval', 'c.schema <> a.schema')} UNION ALL {change('medium', 'Annotations changed after approval', 'c.notes <> a.notes')})"""


def shadowing(named: str, out: str) -> str:
    """``out``: (severity, title, server, tool) of the shadowing detector on (server, name, raw)."""
    return f"""{out}_same AS (SELECT name, list_sort(list(DISTINCT server)) AS servers, count(DISTINCT raw) AS texts FROM {named} GROUP BY name HAVING count(DISTINCT server) >= 2),
{out}_near AS (SELECT list_sort(list(DISTINCT name)) AS names, list_sort(list(DISTINCT server)) AS servers FROM {named} GROUP BY regexp_replace(lower(name), '[^a-z0-9]', '', 'g') HAVING count(DISTINCT name) >= 2 AND count(DISTINCT server) >= 2),
{out}_names AS (SELECT name AS other, count(DISTINCT server) AS n, min(server) AS owner FROM {named} WHERE name <> '' GROUP BY name),
{out}_refs AS (SELECT server, name FROM {named}, {out}_names WHERE contains(lower(raw), lower(other)) AND other <> name AND (n > 1 OR owner <> server) GROUP BY server, name),
{out} AS (SELECT CASE WHEN texts >= 2 THEN 'high' ELSE 'medium' END AS severity, 'Tool name ''' || name || ''' is offered by ' || len(servers) || ' servers' AS title, servers[1] AS server, name AS tool FROM {out}_same
  UNION ALL SELECT 'medium', 'Nearly equal tool names: ' || array_to_string(names, ', '), servers[1], NULL FROM {out}_near
  UNION ALL SELECT 'high', 'Description names tools of another server: ' || name, server, name FROM {out}_refs)"""


def descended(rows: str, out: str, names: tuple[str, ...], models: int, epochs: int, l2: float = 1e-3, rate: float = 0.5) -> str:
    """``out``: (m, w, b, mean, std) of full-batch gradient models on ``rows`` (label, fold, features); model m leaves out fold m."""
    mean, std = (f"[{', '.join(f'{f}({n})' for n in names)}]" for f in ("avg", "stddev_pop"))
    scaled = ", ".join(f"({n} - mean[{i}]) / std[{i}]" for i, n in enumerate(names, 1))
    steps = [f"""{out}_stats AS MATERIALIZED (SELECT m, count(*) AS n, sum(label) AS pos, {mean} AS mean, list_transform({std}, lambda v: CASE WHEN v = 0 THEN 1 ELSE v END) AS std FROM {rows}, range({models}) t(m) WHERE fold <> m GROUP BY m),
{out}_x AS MATERIALIZED (SELECT m, label, n, CASE WHEN label = 1 THEN n / (2 * pos) ELSE n / (2 * (n - pos)) END AS weight, CAST([{scaled}] AS DOUBLE[]) AS x FROM {rows} JOIN {out}_stats ON fold <> m),
{out}_0 AS (SELECT m, list_transform(range({len(names)}), lambda i: CAST(0 AS DOUBLE)) AS w, CAST(0 AS DOUBLE) AS b FROM {out}_stats)"""]
    sums = ", ".join(f"sum(e * x[{i}])" for i in range(1, len(names) + 1))
    for i in range(epochs):
        steps.append(f"""{out}_{i + 1} AS MATERIALIZED (SELECT m, list_transform(g, lambda v, i: w[i] - {rate} * (v / n + {l2} * w[i])) AS w, b - {rate} * gb / n AS b FROM {out}_{i} JOIN
  (SELECT m, any_value(n) AS n, [{sums}] AS g, sum(e) AS gb FROM (SELECT m, n, x, (1 / (1 + exp(-(b + list_dot_product(w, x)))) - label) * weight AS e FROM {out}_x JOIN {out}_{i} USING (m)) GROUP BY m) USING (m))""")
    return ",\n".join(steps) + f",\n{out} AS MATERIALIZED (SELECT m, w, b, mean, std FROM {out}_{epochs} JOIN {out}_stats USING (m))"


def parts_of_decision(names: tuple[str, ...]) -> str:
    """The contribution of each feature to the decision of a row beside its model."""
    return "[" + ", ".join(f"w[{i}] * ({n} - mean[{i}]) / std[{i}]" for i, n in enumerate(names, 1)) + "]"


def confusion(rows: str, by: str = "", more: str = "") -> str:
    """Rates of ``rows`` (p, label)."""
    cell = lambda c: f"count(*) FILTER (WHERE {c})"
    tp, fp, tn, fn = (cell(c) for c in ("p >= 0.5 AND label = 1", "p >= 0.5 AND label <> 1", "p < 0.5 AND label <> 1", "p < 0.5 AND label = 1"))
    share = lambda a, b: f"round(coalesce(({a}) / nullif({b}, 0), 0), 4)"
    return f"""SELECT {by + ', ' if by else ''}{more}{tp} AS tp, {fp} AS fp, {tn} AS tn, {fn} AS fn, {share(tp, f'{tp} + {fp}')} AS precision, {share(tp, f'{tp} + {fn}')} AS recall,
  {share(f'2 * {tp}', f'2 * {tp} + {fp} + {fn}')} AS f1, {share(f'{tp} + {tn}', 'count(*)')} AS accuracy FROM {rows}{' GROUP BY ' + by if by else ''}"""
