"""DuckDB SQL for the queries of ``catalog.queries``, written from the semantics alone."""

from __future__ import annotations

from catalog.shapes import BATCH, BETA, DEVICES, INSTRUCTION, TOKENS
from sftprep.functions.text import HANGUL, PYTHON_WHITESPACE
from sftprep.functions.tokens import TOKEN_PATTERN

SEED = 2025
RATIO = "0.1::DOUBLE"
SHARDS = 10
ACCENTS = "À-ÿ"
ADDED_CLASS, ADDED_GROUP = "ß", 16


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def chars(value: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in value)


RE = quoted(TOKEN_PATTERN.replace("\\t", "\t").replace("\\n", "\n").replace("\\r", "\r"))
WS = chars(PYTHON_WHITESPACE)
NL = "chr(10)"
PAD, UNK, IM_START, IM_END = range(4)
ASSISTANT = TOKENS.reserved.index("assistant")
LENGTH = TOKENS.data_max_length + TOKENS.target_max_length
PROMPT_LENGTH = TOKENS.data_max_length

STRUCTURAL = """structural AS (
  SELECT record_id, instruction, input, response FROM (
    SELECT conv_id * 1000000 + turn AS record_id, role, text AS response,
      first_value(CASE WHEN role = 'system' THEN text END IGNORE NULLS) OVER so_far AS instruction,
      last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER so_far AS input
    FROM conversations WINDOW so_far AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'assistant')"""


def turn(role: str, content: str) -> str:
    return f"'<|im_start|>' || {role} || {NL} || {content} || '<|im_end|>' || {NL}"


def ranked(rel: str, key: str) -> str:
    """``val`` or not, by md5 rank."""
    return (
        f"SELECT *, row_number() OVER (ORDER BY md5('{SEED}:' || {key}), {key}) "
        f"<= ceil({RATIO} * count(*) OVER ()) AS is_val FROM {rel}"
    )


def vocab(name: str = "vocab", where: str = "true", reserved=TOKENS.reserved) -> str:
    """CTEs ending in ``name (token, id, freq)``."""
    fixed = "".join(
        f"SELECT {quoted(t)} AS token, {i} AS id, "
        f"coalesce((SELECT freq FROM {name}_counts WHERE token = {quoted(t)}), 0) AS freq UNION ALL "
        for i, t in enumerate(reserved)
    )
    known = ", ".join(quoted(t) for t in reserved) or "''"
    return f"""{name}_counts AS (
  SELECT token, count(*) AS freq
  FROM (SELECT unnest(regexp_extract_all(text, {RE})) AS token FROM documents WHERE {where})
  GROUP BY token),
{name} AS ({fixed}
  SELECT token, (row_number() OVER (ORDER BY freq DESC, token) - 1 + {len(reserved)})::INT AS id, freq
  FROM {name}_counts WHERE token NOT IN ({known}))"""


def elements(name: str, rel: str, key: str, tokens: str) -> str:
    """Long form ``name (k, p, token)`` of a token list."""
    return f"""{name} AS (
  SELECT {key} AS k, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS p
  FROM (SELECT {key}, {tokens} AS t FROM {rel}))"""


def labels(name: str, rel: str, start: list[int], end: list[int]) -> str:
    """``name (k, p, label)`` from ``rel (k, p, id)``.

    The end that start i takes is number ``i + max(m <= i: ends before start m, less m)``:
    the pointer over the ends either moves on by one or jumps to the first end behind
    the start. A position is labelled if a span opened at or before it ends behind it.
    """

    def match(pattern):
        parts = [f"id = {pattern[0]}"] + [
            f"lead(id, {o}) OVER w IS NOT DISTINCT FROM {t}" for o, t in enumerate(pattern) if o
        ]
        return " AND ".join(parts)

    return f"""{name}_marks AS (
  SELECT k, p, id, {match(start)} AS is_start, {match(end)} AS is_end
  FROM {rel} WINDOW w AS (PARTITION BY k ORDER BY p)),
{name}_counted AS (
  SELECT *, count(*) FILTER (is_end) OVER w AS ends_before,
    count(*) FILTER (is_start) OVER w - 1 AS start_no
  FROM {name}_marks WINDOW w AS (PARTITION BY k ORDER BY p)),
{name}_starts AS (
  SELECT k, p, start_no + max(ends_before - start_no) OVER (PARTITION BY k ORDER BY p) AS end_no
  FROM {name}_counted WHERE is_start),
{name}_ends AS (SELECT k, p AS at, ends_before - 1 AS end_no FROM {name}_counted WHERE is_end),
{name}_spans AS (
  SELECT s.k, s.p + {len(start)} AS p, coalesce(e.at, 1000000000) AS stop
  FROM {name}_starts s LEFT JOIN {name}_ends e ON s.k = e.k AND s.end_no = e.end_no),
{name} AS (
  SELECT k, p, CASE WHEN max(stop) OVER (PARTITION BY k ORDER BY p) > p THEN id ELSE -100 END AS label
  FROM (SELECT r.k, r.p, r.id, s.stop FROM {rel} r LEFT JOIN {name}_spans s ON r.k = s.k AND r.p = s.p))"""


def encoded(name: str, rel: str, key: str, prompt: str, length: int, left: bool = False) -> str:
    """``name (k, input_ids, attention_mask, labels)`` of the prompts in ``rel``."""
    at = f"p + {length} - count(*) OVER (PARTITION BY k)" if left else "p"
    return ",\n".join(
        [
            elements(
                f"{name}_el", rel, key, f"list_slice(regexp_extract_all({prompt}, {RE}), 1, {length})"
            ),
            f"""{name}_padded AS (
  SELECT g.k, g.p, coalesce(e.id, {PAD}) AS id, (e.id IS NOT NULL)::INT AS mask
  FROM (SELECT {key} AS k, unnest(range({length})) AS p FROM {rel}) g
  LEFT JOIN (SELECT k, {at} AS p, coalesce(v.id, {UNK}) AS id FROM {name}_el LEFT JOIN vocab v USING (token)) e
    ON g.k = e.k AND g.p = e.p)""",
            labels(f"{name}_labels", f"{name}_padded", [IM_START, ASSISTANT], [IM_END]),
            f"""{name} AS (
  SELECT k, string_agg(id, ' ' ORDER BY p) AS input_ids,
    string_agg(mask, ' ' ORDER BY p) AS attention_mask,
    string_agg(label, ' ' ORDER BY p) AS labels
  FROM {name}_padded JOIN {name}_labels USING (k, p) GROUP BY k)""",
        ]
    )


def stripped(column: str) -> str:
    return f"trim(coalesce({column}, '_'), {WS})"


STRUCTURAL_PROMPT = " || ".join(
    turn(f"'{role}'", stripped(column))
    for role, column in (("system", "instruction"), ("user", "input"), ("assistant", "response"))
)
OPEN_PROMPT = (
    " || ".join(
        turn(f"'{role}'", stripped(column))
        for role, column in (("system", "instruction"), ("user", "input"))
    )
    + f" || '<|im_start|>assistant' || {NL}"
)

RENDERED = f"""rendered AS (
  SELECT conv_id, count(*) AS turns,
    string_agg({turn('role', 'text')}, '' ORDER BY turn) AS prompt
  FROM conversations GROUP BY conv_id)"""

DROPPED = f"""dropped AS (
  SELECT conv_id, count(*) - 1 AS turns,
    coalesce(string_agg({turn('role', 'text')}, '' ORDER BY turn) FILTER (turn < last), '') AS prompt
  FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) GROUP BY conv_id)"""

PAIRS = f"""labelled AS (
  SELECT *, row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1 AS rank
  FROM documents JOIN labels USING (doc_id)),
fewer AS (
  SELECT least(count(*) FILTER (quality = 1), count(*) FILTER (quality = 0)) AS n FROM labelled),
pairs AS (
  SELECT greatest(c.rank, r.rank) AS pair, '{INSTRUCTION}' AS instruction, c.source AS input,
    c.text AS chosen, r.text AS rejected
  FROM labelled c, labelled r, fewer
  WHERE c.quality = 1 AND r.quality = 0 AND c.rank % n = r.rank % n)"""


def pair_prompt(column: str) -> str:
    return " || ".join(
        turn(f"'{role}'", stripped(c))
        for role, c in (("system", "instruction"), ("user", "input"), ("assistant", column))
    )


PREDICTIONS = f"""{STRUCTURAL},
base AS (SELECT *, row_number() OVER (ORDER BY record_id) - 1 AS pos FROM structural),
size AS (SELECT count(*) AS n FROM base),
dealt AS (
  SELECT pos, input FROM base
  UNION ALL
  SELECT n + i, input FROM base, size, range({DEVICES - 1}) r(i)
  WHERE pos = n - 1 AND i < ({DEVICES} - n % {DEVICES}) % {DEVICES}),
shards AS (
  SELECT pos AS index, translate('Re: ' || input, {NL} || chr(13), '  ') AS response,
    (pos % {DEVICES})::INT AS device_num, pos // {DEVICES * BATCH} AS batch_idx
  FROM dealt)"""

LOGITS = f"""vectors AS (
  SELECT vec_id // 4 AS pair, vec_id % 4 AS role,
    list_transform(embedding, lambda x: x::DOUBLE * 10) AS x FROM embeddings),
whole AS (SELECT pair FROM vectors GROUP BY pair HAVING count(*) = 4),
long AS (
  SELECT pair, role, unnest(x) AS x, generate_subscripts(x, 1) - 1 AS element FROM vectors JOIN whole USING (pair)),
probs AS (
  SELECT pair, role, element, x - m - ln(sum(exp(x - m)) OVER (PARTITION BY pair, role)) AS p
  FROM (SELECT *, max(x) OVER (PARTITION BY pair, role) AS m FROM long)),
relative AS (
  SELECT pair, element,
    max(p) FILTER (role = 0) - max(p) FILTER (role = 2) AS chosen,
    max(p) FILTER (role = 1) - max(p) FILTER (role = 3) AS rejected
  FROM probs GROUP BY pair, element),
scored AS (
  SELECT *, chosen - rejected AS margin,
    greatest(-{BETA} * (chosen - rejected), 0) + ln(1 + exp(-abs({BETA} * (chosen - rejected)))) AS loss
  FROM relative)"""

METRICS = {
    "loss": "avg(loss)",
    "chosen_logprob": "avg(chosen)",
    "rejected_logprob": "avg(rejected)",
    "reward_accuracy": "avg((chosen > rejected)::INT)",
    "reward_margin": "avg(margin)",
}

TRIALS = """trials AS (
  SELECT user_id AS trial, round(avg(value), 6) AS value, count(*) AS steps, min(event_id) AS first_step
  FROM events GROUP BY user_id)"""

TURN_IDS = f"""WITH {vocab()},
turns AS (SELECT conv_id || '-' || turn AS turn_key, text FROM conversations),
{elements('el', 'turns', 'turn_key', f'regexp_extract_all(text, {RE})')}
SELECT turn_key, coalesce(string_agg(coalesce(id, {UNK}), ' ' ORDER BY p) FILTER (p IS NOT NULL), '') AS ids
FROM turns LEFT JOIN el ON k = turn_key LEFT JOIN vocab USING (token) GROUP BY turn_key"""

LENGTHS = f"list_transform(regexp_extract_all(text, {RE}), lambda t: length(t)::INT)"
LONGEST = 1024


def joined(items: str) -> str:
    return f"array_to_string({items}, ' ')"


def padded(items: str, value: str, left: bool) -> str:
    fill = f"list_resize([]::INT[], ({LONGEST} - len({items}))::BIGINT, {value})"
    return joined(f"list_concat({fill}, {items})" if left else f"list_concat({items}, {fill})")


def starts(pattern: list[int]) -> str:
    test = " AND ".join(f"ids[i + {o + 1}] = {t}" for o, t in enumerate(pattern))
    return joined(f"list_filter(range(greatest(len(ids) - {len(pattern) - 1}, 0)), lambda i: {test})")


def masked(rel: str, key: str, tokens: str, length: int | None) -> str:
    """T7 over token lengths, start 2 1, end 9; padded with 9 to ``length``."""
    grid = (
        "SELECT k, p, token AS id FROM el"
        if length is None
        else f"""SELECT g.k, g.p, coalesce(el.token, 9) AS id
  FROM (SELECT {key} AS k, unnest(range({length})) AS p FROM {rel}) g
  LEFT JOIN el ON g.k = el.k AND g.p = el.p"""
    )
    keys = key if length is None else "conv_id, turn"
    return f"""WITH turns AS (SELECT *, conv_id * 1000000 + turn AS id FROM conversations),
{elements('el', rel, key, tokens)},
x AS ({grid}),
{labels('found', 'x', [2, 1], [9])}
SELECT {keys}, coalesce(string_agg(label, ' ' ORDER BY p), '') AS labels
FROM {rel} LEFT JOIN found ON k = {key} GROUP BY {keys}"""


def extended(letters: str = ACCENTS, group: int = 128) -> str:
    """CTEs ending in ``extended (token, id, freq)``, beside ``vocab``."""
    return f"""{vocab('other', "lang <> 'en'", ())},
new AS (
  SELECT token, freq, row_number() OVER (ORDER BY freq DESC, token) - 1 AS slot, count(*) OVER () AS n
  FROM other WHERE regexp_matches(token, '[{letters}]') AND token NOT IN (SELECT token FROM vocab)),
extended AS (
  SELECT token, id, freq FROM vocab
  UNION ALL
  SELECT token, ((SELECT max(id) + 1 FROM vocab) + slot)::INT, freq FROM new WHERE slot < n // {group} * {group})"""


EXTENDED = extended()

SPLIT_DOCS = f"split AS ({ranked('documents', 'doc_id')})"

MODES = f"""WITH {SPLIT_DOCS}, modes AS (
  SELECT doc_id, 'train' AS mode FROM split WHERE NOT is_val
  UNION ALL SELECT doc_id, 'train_all' FROM split
  UNION ALL SELECT doc_id, 'val' FROM split WHERE is_val
  UNION ALL SELECT doc_id, 'test' FROM split
  UNION ALL SELECT doc_id, 'predict' FROM split)"""


def sft_job(records: str, key: str) -> str:
    """Strict training part of ``records (key, instruction, input, response)``."""
    return f"""WITH {vocab()}, {STRUCTURAL},
documents_as_records AS (
  SELECT doc_id, lang AS instruction, source AS input, text AS response FROM documents),
split AS ({ranked(records, key)}),
prompts AS (
  SELECT {key}, row_number() OVER (ORDER BY {key}) - 1 AS pos, {STRUCTURAL_PROMPT} AS prompt
  FROM split WHERE NOT is_val),
{encoded('enc', 'prompts', key, 'prompt', LENGTH)}
SELECT {key}, pos, input_ids, attention_mask, labels FROM prompts JOIN enc ON k = {key}"""


# The echo generator: the first 64 tokens of the prompt once more
PREDICT_PROMPTS = f"""{STRUCTURAL}, {vocab()},
base AS (SELECT *, row_number() OVER (ORDER BY record_id) - 1 AS pos, {OPEN_PROMPT} AS prompt FROM structural),
{elements('el', 'base', 'pos', f'list_slice(regexp_extract_all(prompt, {RE}), 1, 64)')},
echoed AS (SELECT k, p, coalesce(id, {UNK}) AS id, v.token FROM el LEFT JOIN vocab v USING (token))"""

ORACLE = {
    "read_parquet": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "read_json": f"WITH {STRUCTURAL} SELECT * FROM structural",
    "read_jsonl": f"WITH {RENDERED} SELECT conv_id, prompt FROM rendered",
    "read_csv": "SELECT doc_id, lang, CASE WHEN source <> 'src3' THEN source END AS source, text FROM documents",
    "read_tsv": "SELECT doc_id, lang, source, text FROM documents",
    "load_dataset": f"""WITH {STRUCTURAL}
SELECT format, structural.* FROM structural, unnest(['parquet', 'json', 'jsonl', 'csv', 'tsv']) f(format)""",
    "write_prediction_shards": f"""WITH {PREDICTIONS}
SELECT device_num, batch_idx::INT AS batch_idx, count(*) AS rows, sum(index)::BIGINT AS index_sum
FROM shards GROUP BY ALL""",
    "read_prediction_shards": f"""WITH {PREDICTIONS}
SELECT index, nullif(response, '') AS response, device_num, batch_idx FROM shards""",
    "write_submission": f"""WITH {PREDICTIONS}
SELECT record_id, instruction, base.input, shards.response
FROM base JOIN shards ON pos = index""",
    "sharded_export": f"""SELECT doc_id, format('model-{{:05d}}-of-{SHARDS:05d}', 1 + CASE
    WHEN n // {SHARDS} = 0 THEN {SHARDS - 1} ELSE least(pos // (n // {SHARDS}), {SHARDS - 1}) END) AS file
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)""",
    "sharded_export_size": "SELECT sum(octet_length(encode(text)))::BIGINT AS total_size FROM documents",
    "select_fields": "SELECT doc_id, lang AS instruction, source AS input, text AS response FROM documents",
    "fill_missing": f"""WITH {STRUCTURAL}
SELECT record_id, coalesce(instruction, '_') AS instruction, coalesce(input, '_') AS input,
  coalesce(response, '_') AS response FROM structural""",
    "strip_text": f"""SELECT doc_id, trim({chars('　 ')} || ' ' || chr(9) || text || chr(10) || '  ', {WS}) AS text
FROM documents""",
    "project_turns": "SELECT conv_id, turn, role, text AS content FROM conversations",
    "drop_last_turn": f"WITH {DROPPED} SELECT conv_id, turns::INT AS turns, prompt FROM dropped",
    "drop_token_types": "SELECT doc_id, n_chars FROM documents",
    "script_filter": f"""SELECT doc_id, regexp_matches(text, '[{ACCENTS}]') AS accented,
  regexp_matches(text, '[{HANGUL}]') AS hangul FROM documents""",
    "clean_generation": f"SELECT doc_id, translate(text, {NL} || chr(13), '  ') AS text FROM documents",
    "split_exact": f"""SELECT o_orderkey, CASE WHEN is_val THEN 'val' ELSE 'train' END AS split
FROM ({ranked('orders', 'o_orderkey')})""",
    "split_mode": f"{MODES} SELECT doc_id, mode FROM modes",
    "row_index": """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos
FROM orders""",
    "pad_tail": f"""WITH base AS (
  SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)
SELECT doc_id, source, pos FROM base
UNION ALL
SELECT doc_id, source, n + i FROM base, range({DEVICES - 1}) r(i)
WHERE pos = n - 1 AND i < ({DEVICES} - n % {DEVICES}) % {DEVICES}""",
    "epoch_shuffle": f"""SELECT mode, epoch, doc_id,
  row_number() OVER (PARTITION BY mode, epoch ORDER BY
    CASE WHEN mode = 'train' THEN md5('{SEED}:' || epoch || ':' || doc_id) ELSE '' END, doc_id) - 1 AS visit
FROM documents, (VALUES ('train', 0), ('train', 1), ('val', 1)) m(mode, epoch)""",
    "assign_batches": f"""SELECT o_orderkey, pos, (pos % {DEVICES})::INT AS device_num,
  (pos // {DEVICES}) // {BATCH} AS batch_idx
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders)""",
    "to_messages": f"""WITH {STRUCTURAL}
SELECT record_id, 0 AS turn, 'system' AS role, coalesce(instruction, '_') AS content FROM structural
UNION ALL SELECT record_id, 1, 'user', coalesce(input, '_') FROM structural
UNION ALL SELECT record_id, 2, 'assistant', coalesce(response, '_') FROM structural""",
    "render_chat": f"""WITH {RENDERED}
SELECT conv_id, prompt, prompt || '<|im_start|>assistant' || {NL} AS open_prompt FROM rendered""",
    "render_template": f"""WITH said AS (
  SELECT *, role = 'assistant' AND turn >= coalesce(
      max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id), turn) AS kept,
    '<think>' || {NL} || length(text) || {NL} || '</think>' || {NL} || {NL} AS thought
  FROM conversations),
rendered AS (
  SELECT conv_id, string_agg({turn('role', "CASE WHEN kept THEN thought ELSE '' END || text")}, '' ORDER BY turn) AS prompt,
    string_agg(CASE role
      WHEN 'system' THEN '<<SYS>>' || {NL} || text || {NL} || '<</SYS>>' || {NL} || {NL}
      WHEN 'user' THEN '[INST] ' || text || ' [/INST]'
      ELSE ' ' || thought || text || ' </s>' END, '' ORDER BY turn) AS blocks
  FROM said GROUP BY conv_id)
SELECT conv_id, prompt, prompt || '<|im_start|>assistant' || {NL} AS thinking,
  prompt || '<|im_start|>assistant' || {NL} || '<think>' || {NL} || {NL} || '</think>' || {NL} || {NL} AS not_thinking,
  blocks || ' ' AS blocks FROM rendered""",
    "prepare_template_sft": f"""WITH {STRUCTURAL},
base AS (
  SELECT record_id, row_number() OVER (ORDER BY record_id) - 1 AS pos, count(*) OVER () AS n,
    {OPEN_PROMPT} || '<think>' || {NL} || {NL} || '</think>' || {NL} || {NL} AS prompt FROM structural),
dealt AS (
  SELECT record_id, pos, prompt FROM base
  UNION ALL
  SELECT record_id, n + i, prompt FROM base, range({DEVICES - 1}) r(i)
  WHERE pos = n - 1 AND i < ({DEVICES} - n % {DEVICES}) % {DEVICES})
SELECT record_id, pos, (pos % {DEVICES})::INT AS device_num, pos // {DEVICES * BATCH} AS batch_idx, prompt FROM dealt""",
    "assemble_conversations": f"""SELECT conv_id, count(*)::INT AS turns,
  string_agg(role, ',' ORDER BY turn) AS roles, string_agg(text, {NL} ORDER BY turn) AS contents
FROM conversations GROUP BY conv_id""",
    "remap_markers": f"""WITH {RENDERED}
SELECT conv_id, replace(replace(replace(replace(prompt, '<|im_start|>assistant', '[A]'),
  '<|im_end|>', '[E]'), '<|im_start|>user', '[U]'), '<|im_start|>system', '[S]') AS prompt FROM rendered""",
    "render_pair": f"""WITH {PAIRS}
SELECT pair, pair AS pos, {pair_prompt('chosen')} AS prompt_chosen,
  {pair_prompt('rejected')} AS prompt_rejected FROM pairs""",
    "tokenize": f"""SELECT doc_id, len(t)::INT AS size, array_to_string(t, '␟') AS tokens
FROM (SELECT doc_id, regexp_extract_all(text, {RE}) AS t FROM documents)""",
    "lookup_ids": TURN_IDS,
    "lookup_ids_by_join": TURN_IDS,
    "truncate": f"""SELECT doc_id, len(t)::INT AS size, array_to_string(t, '') AS text
FROM (SELECT doc_id, list_slice(regexp_extract_all(text, {RE}), 1, 256) AS t FROM documents)""",
    "pad_ids": f"""SELECT conv_id, turn, {padded('ids', '0', False)} AS right_padded, {padded('ids', '0', True)} AS left_padded
FROM (SELECT conv_id, turn, {LENGTHS} AS ids FROM conversations)""",
    "attention_mask": f"""SELECT conv_id, turn, {padded('ones', '0', False)} AS right_padded,
  {padded('ones', '0', True)} AS left_padded
FROM (SELECT conv_id, turn, list_transform({LENGTHS}, lambda i: 1) AS ones FROM conversations)""",
    "find_pattern": f"""SELECT doc_id, {starts([1, 2])} AS pairs, {starts([1, 3, 1])} AS triples
FROM (SELECT doc_id, {LENGTHS} AS ids FROM documents)""",
    "mask_labels": masked('documents', 'doc_id', LENGTHS, None),
    "mask_labels_padded": masked('turns', 'id', LENGTHS, LONGEST),
    "full_labels": f"""WITH {vocab()}, {STRUCTURAL},
prompts AS (SELECT record_id, {STRUCTURAL_PROMPT} AS prompt FROM structural),
{encoded('enc', 'prompts', 'record_id', 'prompt', LENGTH)}
SELECT k AS record_id, input_ids AS labels FROM enc""",
    "strip_prompt": f"SELECT doc_id, {joined(f'({LENGTHS})[101:]')} AS ids FROM documents",
    "decode_ids": f"""SELECT doc_id, array_to_string(
  list_filter(regexp_extract_all(text, {RE}), lambda t: t <> ' '), '') AS text FROM documents""",
    "argmax": "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS pred FROM embeddings",
    "build_vocab": f"WITH {vocab()} SELECT token, id, freq FROM vocab",
    "extend_vocab": f"""WITH {vocab('vocab', "lang = 'en'", ())}, {EXTENDED} SELECT token, id, freq FROM extended""",
    "append_special": f"""WITH {vocab()}
SELECT token, id, freq FROM vocab
UNION ALL
SELECT token, ((SELECT max(id) FROM vocab) + i)::INT, 0 FROM (VALUES ('<think>', 1), ('</think>', 2)) t(token, i)""",
    "merge_predictions": f"""WITH {PREDICTIONS}
SELECT record_id, instruction, base.input, pos, shards.response FROM base JOIN shards ON pos = index""",
    "union_shards": f"WITH {PREDICTIONS} SELECT * FROM shards",
    "sort_by_index": f"WITH {PREDICTIONS} SELECT index, response FROM shards",
    "count_guard": f"""WITH {PREDICTIONS},
kept AS (SELECT * FROM shards WHERE device_num <> 3),
missing AS (SELECT pos FROM base ANTI JOIN kept ON pos = index)
SELECT (SELECT n FROM size) AS base_rows, (SELECT count(*) FROM kept) AS predictions,
  (SELECT count(*) FROM missing) AS missing,
  (SELECT count(*) FROM kept WHERE index >= (SELECT n FROM size)) AS surplus,
  0::BIGINT AS duplicates, (SELECT min(pos) FROM missing) AS first_missing""",
    "count_guard_trim": f"WITH {PREDICTIONS} SELECT index, response FROM shards SEMI JOIN base ON pos = index",
    "log_softmax": """WITH long AS (
  SELECT vec_id, unnest(embedding)::DOUBLE * 10 AS x, (generate_subscripts(embedding, 1) - 1)::INT AS element
  FROM embeddings)
SELECT vec_id, element, round(x - m - ln(sum(exp(x - m)) OVER (PARTITION BY vec_id)), 6) AS p
FROM (SELECT *, max(x) OVER (PARTITION BY vec_id) AS m FROM long)""",
    "relative_logprob": f"""WITH {LOGITS}
SELECT pair, element::INT AS element, round(chosen, 6) AS chosen, round(rejected, 6) AS rejected FROM relative""",
    "dpo_loss": f"WITH {LOGITS} SELECT round(avg(loss), 6) AS loss FROM scored",
    "mean_logprobs": f"""WITH {LOGITS}
SELECT round(avg(chosen), 6) AS chosen_logprob, round(avg(rejected), 6) AS rejected_logprob FROM scored""",
    "reward_accuracy": f"WITH {LOGITS} SELECT round({METRICS['reward_accuracy']}, 6) AS reward_accuracy FROM scored",
    "reward_margin": f"WITH {LOGITS} SELECT round(avg(margin), 6) AS reward_margin FROM scored",
    "epoch_metrics": """WITH steps AS (
  SELECT user_id AS run, event_type AS split, day(ts)::INT AS epoch, 'value' AS metric, value,
    (props ->> '$.k')::BIGINT AS batch_size FROM events)
SELECT run, split, epoch, metric, round(sum(value * batch_size) / nullif(sum(batch_size) FILTER (value IS NOT NULL), 0), 6) AS value
FROM steps GROUP BY run, split, epoch, metric""",
    "best_trial": f"""WITH {TRIALS}
(SELECT trial, value, to_json({{'steps': steps, 'first_step': first_step}})::VARCHAR AS params, 'min' AS direction
FROM trials ORDER BY value, trial LIMIT 1)
UNION ALL
(SELECT trial, value, to_json({{'steps': steps, 'first_step': first_step}})::VARCHAR, 'max'
FROM trials ORDER BY value DESC, trial LIMIT 1)""",
    "write_best_trial": f"""WITH {TRIALS}
SELECT steps, first_step FROM trials ORDER BY value, trial LIMIT 1""",
    "row_counts": f"{MODES} SELECT mode, count(*) AS rows FROM modes GROUP BY mode",
    "generate_sequences": f"""WITH {PREDICT_PROMPTS},
made AS (SELECT k, string_agg(id, ' ' ORDER BY p) AS ids FROM echoed GROUP BY k),
size AS (SELECT count(*) AS n FROM base)
SELECT k AS pos, ids FROM made
UNION ALL
SELECT n + i, ids FROM made, size, range({DEVICES - 1}) r(i)
WHERE k = n - 1 AND i < ({DEVICES} - n % {DEVICES}) % {DEVICES}""",
    "tokenizer_plugin": "SELECT doc_id, hex(encode(text)) AS bytes FROM documents",
    "prepare_sft": sft_job("structural", "record_id"),
    "prepare_sft_documents": sft_job("documents_as_records", "doc_id"),
    "prepare_chat_sft": f"""WITH {vocab()}, {RENDERED},
split AS ({ranked('rendered', 'conv_id')}),
prompts AS (
  SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS pos, prompt FROM split WHERE NOT is_val),
{encoded('enc', 'prompts', 'conv_id', 'prompt', LENGTH)}
SELECT conv_id, pos, input_ids, attention_mask, labels FROM prompts JOIN enc ON k = conv_id""",
    "prepare_preference": f"""WITH {vocab()}, {PAIRS},
prompts AS (SELECT pair, {pair_prompt('chosen')} AS good, {pair_prompt('rejected')} AS bad FROM pairs),
{encoded('c', 'prompts', 'pair', 'good', LENGTH)},
{encoded('r', 'prompts', 'pair', 'bad', LENGTH)}
SELECT c.k AS pair, c.k AS pos,
  c.input_ids AS chosen_input_ids, c.attention_mask AS chosen_attention_mask, c.labels AS chosen_labels,
  r.input_ids AS rejected_input_ids, r.attention_mask AS rejected_attention_mask, r.labels AS rejected_labels
FROM c JOIN r USING (k)""",
    "prepare_predict": f"""WITH {vocab()}, {DROPPED},
numbered AS (
  SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS pos, count(*) OVER () AS n,
    prompt || '<|im_start|>assistant' || {NL} AS prompt FROM dropped),
prompts AS (
  SELECT conv_id, pos, prompt FROM numbered
  UNION ALL
  SELECT conv_id, n + i, prompt FROM numbered, range({DEVICES - 1}) r(i)
  WHERE pos = n - 1 AND i < ({DEVICES} - n % {DEVICES}) % {DEVICES}),
{encoded('enc', 'prompts', 'pos', 'prompt', PROMPT_LENGTH)}
SELECT conv_id, pos, (pos % {DEVICES})::INT AS device_num, pos // {DEVICES * BATCH} AS batch_idx,
  input_ids, attention_mask FROM prompts JOIN enc ON k = pos""",
    "prepare_predict_preference": f"""WITH {vocab()}, {PAIRS},
numbered AS (SELECT pair, count(*) OVER () AS n, {OPEN_PROMPT} AS prompt FROM pairs),
prompts AS (
  SELECT pair, pair AS pos, prompt FROM numbered
  UNION ALL
  SELECT pair, n + i, prompt FROM numbered, range({DEVICES - 1}) r(i)
  WHERE pair = n - 1 AND i < ({DEVICES} - n % {DEVICES}) % {DEVICES}),
{encoded('enc', 'prompts', 'pos', 'prompt', PROMPT_LENGTH)}
SELECT pair, pos, (pos % {DEVICES})::INT AS device_num, pos // {DEVICES * BATCH} AS batch_idx,
  input_ids AS chosen_input_ids, attention_mask AS chosen_attention_mask,
  input_ids AS rejected_input_ids, attention_mask AS rejected_attention_mask
FROM prompts JOIN enc ON k = pos""",
    "predict_and_merge": f"""WITH {PREDICT_PROMPTS},
made AS (
  SELECT k, translate(string_agg(token, '' ORDER BY p) FILTER (id > {IM_END}), {NL} || chr(13), '  ') AS text
  FROM echoed GROUP BY k)
SELECT record_id, instruction, input, pos, nullif(text, '') AS response FROM base JOIN made ON k = pos""",
    "extend_vocabulary": f"""WITH {vocab('vocab', "lang = 'en'")}, {EXTENDED}
SELECT token, id, freq FROM extended
UNION ALL
SELECT token, ((SELECT max(id) FROM extended) + i)::INT, 0 FROM (VALUES ('<think>', 1), ('</think>', 2)) t(token, i)""",
    "encode_added_tokens": f"""WITH {vocab('vocab', "lang = 'en'")}, {extended(ADDED_CLASS, ADDED_GROUP)},
whole AS (
  SELECT token, id FROM extended
  UNION ALL
  SELECT token, ((SELECT max(id) FROM extended) + i)::INT FROM (VALUES ('<think>', 1), ('</think>', 2)) t(token, i)),
found AS (
  SELECT string_agg(regexp_escape(token), '|' ORDER BY length(token) DESC, token) AS pattern
  FROM whole WHERE token NOT IN (SELECT token FROM vocab)),
pieces AS (
  SELECT doc_id, unnest(t) AS piece, generate_subscripts(t, 1) AS nth
  FROM (SELECT doc_id, string_split(regexp_replace('<think>' || text || '</think>',
    '(' || pattern || ')', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS t FROM documents, found)),
cut AS (
  SELECT doc_id, nth, unnest(t) AS token, generate_subscripts(t, 1) AS p
  FROM (SELECT doc_id, nth, CASE WHEN nth % 2 = 0 THEN [piece] ELSE regexp_extract_all(piece, {RE}) END AS t
    FROM pieces))
SELECT doc_id, string_agg(coalesce(id, {UNK}), ' ' ORDER BY nth, p) AS ids,
  string_agg(CASE WHEN id IS NULL THEN '<|unk|>' ELSE token END, '' ORDER BY nth, p) AS back
FROM cut LEFT JOIN whole USING (token) GROUP BY doc_id""",
    "prepare_chat_preference": f"""WITH {vocab()},
prompts AS (
  SELECT conv_id, string_agg({turn('role', 'text')}, '' ORDER BY turn) AS good,
    string_agg({turn('role', "CASE WHEN role = 'assistant' THEN translate(text, 'aeiou', '43105') ELSE text END")}, '' ORDER BY turn) AS bad
  FROM conversations GROUP BY conv_id),
{encoded('c', 'prompts', 'conv_id', 'good', LENGTH, left=True)},
{encoded('r', 'prompts', 'conv_id', 'bad', LENGTH, left=True)}
SELECT c.k AS pair, row_number() OVER (ORDER BY c.k) - 1 AS pos,
  c.input_ids AS chosen_input_ids, c.attention_mask AS chosen_attention_mask, c.labels AS chosen_labels,
  r.input_ids AS rejected_input_ids, r.attention_mask AS rejected_attention_mask, r.labels AS rejected_labels
FROM c JOIN r USING (k)""",
    "preference_report": f"""WITH {LOGITS},
steps AS (
  SELECT 'run' || step % 2 AS run, CASE WHEN step % 3 = 0 THEN 'val' ELSE 'train' END AS split,
    step // 20 AS epoch, step, count(DISTINCT pair) AS batch_size,
    {", ".join(f"{value} AS {name}" for name, value in METRICS.items())}
  FROM (SELECT *, pair // 10 AS step FROM scored) GROUP BY ALL),
long_steps AS ({" UNION ALL ".join(
    f"SELECT run, split, epoch, '{name}' AS metric, {name} AS value, batch_size FROM steps"
    for name in METRICS
)})
SELECT run, split, epoch, metric, round(sum(value * batch_size) / sum(batch_size), 6) AS value
FROM long_steps GROUP BY ALL""",
}
ORACLE["sharded_export_manifest"] = ORACLE["sharded_export"]
