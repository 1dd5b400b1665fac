"""Byte-level BPE in SQL for DuckDB: pairs are merged by rank, step by step, as the method is defined. Only tests use it."""

from __future__ import annotations

from ._common import BPE_FILE

#: White space of the split pattern, for a regular expression without look-ahead.
_WHITE = r"\s\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_SPECIAL, _SPECIAL_ID = "<|endoftext|>", 50256


def _ids_of_bytes() -> list[int]:
    """The id of each byte: the printable ones come first, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    order = [*plain, *(b for b in range(256) if b not in plain)]
    return [order.index(b) for b in range(256)]


def encoded(path: str = BPE_FILE) -> str:
    """Common table expressions that end with ``texts_ids`` (rn, doc_id, source, lang, n_tokens, ids, bytes): a row for each document; ids and bytes are text, joined by commas and in hexadecimal.

    A run of white space before a word ends one character early, which the split pattern says with a look-ahead: there the text is cut first.
    """
    cut = f"string_split(regexp_replace(piece, '([{_WHITE}]+)([{_WHITE}][^{_WHITE}])', '\\1' || chr(57344) || '\\2', 'g'), chr(57344))"
    split = rf"'''s|''t|''re|''ve|''m|''ll|''d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+'"
    return f"""
file AS (
  SELECT model FROM read_json('{path}', columns = {{model: 'STRUCT(vocab MAP(VARCHAR, INTEGER), merges VARCHAR[][])'}}, maximum_object_size = 100000000)
), vocab AS (
  SELECT e.key AS letters, e.value AS id FROM (SELECT unnest(map_entries(model.vocab)) AS e FROM file)
), byte_values AS (
  SELECT id, string_agg(lower(printf('%02x', CASE WHEN u < 256 THEN u WHEN u < 289 THEN u - 256 WHEN u < 323 THEN u - 162 ELSE 173 END)), '' ORDER BY k) AS bytes
  FROM (SELECT id, k, unicode(letters[k]) AS u FROM (SELECT id, letters, unnest(range(1, length(letters) + 1)) AS k FROM vocab))
  GROUP BY id UNION ALL SELECT {_SPECIAL_ID}, lower(hex(encode('{_SPECIAL}')))
), merges AS (
  SELECT x.id AS a, y.id AS b, z.id AS m
  FROM (SELECT unnest(model.merges) AS p FROM file) JOIN vocab x ON x.letters = p[1] JOIN vocab y ON y.letters = p[2] JOIN vocab z ON z.letters = p[1] || p[2]
), numbered AS (
  SELECT row_number() OVER () AS rn, doc_id, text, source, lang FROM documents
), pieces AS (
  SELECT rn, place, unnest({cut}) AS piece, generate_subscripts({cut}, 1) AS part
  FROM (SELECT rn, unnest(parts) AS piece, generate_subscripts(parts, 1) AS place
        FROM (SELECT rn, string_split(replace(coalesce(text, ''), '{_SPECIAL}', chr(57345) || '{_SPECIAL}' || chr(57345)), chr(57345)) AS parts FROM numbered))
), words AS (
  SELECT rn, place, part, unnest(ws) AS word, generate_subscripts(ws, 1) AS k
  FROM (SELECT *, CASE WHEN piece = '{_SPECIAL}' THEN [piece] ELSE regexp_extract_all(piece, {split}) END AS ws FROM pieces)
), step AS (
  SELECT word, 0 AS i, CASE WHEN word = '{_SPECIAL}' THEN [{_SPECIAL_ID}]
    ELSE list_transform(range(0, octet_length(encode(word)) * 2, 2), lambda p: list_extract({_ids_of_bytes()}, CAST('0x' || substr(hex(encode(word)), p + 1, 2) AS INTEGER) + 1)) END AS ids
  FROM (SELECT DISTINCT word FROM words)
  UNION ALL
  SELECT word, i + 1, list_reduce(list_transform(ids, lambda x: [x]), lambda acc, x: CASE WHEN acc[-1] = best.a AND x[1] = best.b THEN list_append(acc[:-2], best.m) ELSE list_concat(acc, x) END)
  FROM (
    SELECT word, any_value(i) AS i, any_value(ids) AS ids, arg_min({{'a': a, 'b': b, 'm': m}}, m) AS best
    FROM (SELECT word, i, ids, unnest(ids[:-2]) AS left_id, unnest(ids[2:]) AS right_id FROM step WHERE len(ids) > 1) JOIN merges ON a = left_id AND b = right_id
    GROUP BY word
  )
), word_ids AS (
  SELECT word, len(ids) AS n, array_to_string(ids, ',') AS ids, (SELECT string_agg(v.bytes, '' ORDER BY j) FROM (SELECT unnest(ids) AS id, generate_subscripts(ids, 1) AS j) x JOIN byte_values v USING (id)) AS bytes
  FROM (SELECT word, arg_max(ids, i) AS ids FROM step GROUP BY word)
), text_ids AS (
  SELECT rn, CAST(sum(n) AS BIGINT) AS n_tokens, string_agg(ids, ',' ORDER BY place, part, k) AS ids, string_agg(bytes, '' ORDER BY place, part, k) AS bytes
  FROM words JOIN word_ids USING (word) GROUP BY rn
), texts_ids AS (
  SELECT rn, doc_id, source, lang, coalesce(n_tokens, 0) AS n_tokens, coalesce(ids, '') AS ids, coalesce(bytes, '') AS bytes FROM numbered LEFT JOIN text_ids USING (rn)
)"""
