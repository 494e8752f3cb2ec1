"""DuckDB SQL that says what each query should return, written apart from the Spark plans."""

from __future__ import annotations

from quire import fixed_values as fixed

#: White space at the ends of a text and between words.
_WS = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(_q(w) for w in words) + "]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _hits(low: str, words: list[str]) -> str:
    return f"len(list_filter({_list(words)}, lambda k: contains({low}, lower(k))))"


def _cut(x: str, patterns: list[str]) -> str:
    for p in patterns:
        x = f"regexp_replace({x}, {_q(p)}, '', 'gi')"
    return x


_SNIPPETS = """
  WHEN 1 THEN text || chr(10) || 'CARTA D''IDENTITA COGNOME: ROSSI NOME: MARIO DATA DI NASCITA: 01/01/1990 CITTADINANZA ITALIANA SESSO M'
  WHEN 2 THEN text || chr(10) || 'FIRMA SCADENZA 2028 RILASCIATO DA QUESTURA C<ITA<<<<<<<<ROSSI<<MARIO<<<'
  WHEN 3 THEN text || chr(10) || 'Unique Identification Authority AADHAAR enrollment id 1234'
  WHEN 4 THEN text || chr(10) || 'file:///C:/Users/x/scan.png https://upload.wikimedia.org/a/b storyblok'
  WHEN 5 THEN text || chr(10) || '???? a  ' || chr(9) || 'b' || chr(10) || chr(10) || chr(10) || '•••••' || chr(65533) || chr(1)
  WHEN 6 THEN text || chr(10) || 'identity card surname: SMITH - given name: ANNA place of birth London'
  WHEN 7 THEN text || chr(10) || 'signature - expiry date valid until 2030 barcode seal stamp'
  WHEN 10 THEN text || chr(10) || 'k: 1' || chr(10) || 'k: 2'
  WHEN 11 THEN text || chr(10) || '2/17/26, 9:23 AM Preview Google Chrome'
  WHEN 12 THEN text || chr(10) || '< < <<' WHEN 13 THEN text || chr(10) || 'firma timbro' WHEN 14 THEN text || chr(10) || 'photo image'"""

AUG = f"""aug AS (
  SELECT doc_id, doc_id // 10 AS file, CAST(CASE WHEN doc_id % 50 = 0 THEN 6 ELSE doc_id % 10 // 2 + 1 END AS INT) AS page,
    CAST(CASE WHEN doc_id // 10 % 2 = 0 THEN doc_id % 2 + 1 ELSE 2 - doc_id % 2 END AS INT) AS seg, source,
    CASE doc_id % 16 {_SNIPPETS} ELSE text END AS text
  FROM (SELECT doc_id, text, source FROM documents
    UNION ALL SELECT doc_id + 1000000000000, CASE doc_id % 16 WHEN 8 THEN '' ELSE '12 34 ## 56' END, source FROM documents WHERE doc_id % 16 IN (8, 9)) d)"""

SEG = AUG + """, seg AS (
  SELECT *, lower(text) AS low, (doc_id * 7 % 1001)::DOUBLE / 10 AS ocr, (doc_id * 37 % 1000)::DOUBLE / 1000 AS ink FROM aug)"""

PAGES = SEG + """, pg AS (
  SELECT source AS folder, 'f' || file || '.pdf' AS file, doc_id AS page, ink, ocr, text FROM seg)"""

BOXES = AUG + """, words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT doc_id, string_split_regex(text, '[ \\n]+') AS w FROM aug)
), raw AS (
  SELECT doc_id, pos, CASE WHEN pos % 13 = 0 OR (doc_id % 11 = 0 AND pos % 3 <> 0) THEN ' ' ELSE word END AS text,
    CASE WHEN pos % 29 = 0 THEN 'n/a' WHEN pos % 23 = 0 THEN '-1' ELSE CAST(doc_id * 7 % 90 + pos * 17 % 11 AS VARCHAR) END AS conf FROM words
), box AS (
  SELECT *, greatest(coalesce(TRY_CAST(conf AS DOUBLE), 0), 0) AS c, """ + _strip("text") + """ <> '' AS filled,
    """ + " OR ".join(f"regexp_matches(text, {_q(p)}, 'i')" for p in fixed.BOX_ARTIFACTS) + """ AS artifact FROM raw)"""  # fmt: skip


def _language(text: str) -> str:
    low = f"lower({_strip(_cut(text, fixed.BOX_ARTIFACTS))})"
    return f"(SELECT CASE WHEN i = 0 AND e = 0 THEN 'ita' WHEN i >= e THEN 'ita' ELSE 'eng' END FROM (SELECT {_hits('low', fixed.LANGUAGE_KEYWORDS['ita'])} AS i, {_hits('low', fixed.LANGUAGE_KEYWORDS['eng'])} AS e FROM (SELECT {low} AS low)))"


def _words(table: dict, key: str, lang: str | None = None) -> list[str]:
    langs = table[key]["keywords"]
    return langs.get(lang, []) if lang else list(dict.fromkeys(w for ws in langs.values() for w in ws))


_T, _S = fixed.DOCUMENT_TYPES, fixed.DOCUMENT_SIDES


def _projection(shift: int, name: str) -> str:
    """``halves``, with ``name`` behind it, of the customers' profiles."""
    return f"""base{name} AS (SELECT c_custkey AS page, c_custkey + {shift} AS num, CAST(60 + (c_custkey + {shift}) % 60 AS INT) AS size FROM customer
), prof{name} AS (
  SELECT page, size, pos, CASE WHEN num % 17 = 0 THEN 0 WHEN pos >= num % size AND pos < num % size + num % 9 THEN pos % 4 WHEN pos % 31 = 0 THEN 1 ELSE 20 + (pos * 7 + num) % 30 END AS ink
  FROM (SELECT page, num, size, unnest(range(size)) AS pos FROM base{name})
), low{name} AS (
  SELECT page, size, pos, pos - row_number() OVER (PARTITION BY page ORDER BY pos) AS run FROM (SELECT *, max(ink) OVER (PARTITION BY page) AS most FROM prof{name}) WHERE most > 0 AND ink < greatest(5, floor(most * 0.05))
), runs{name} AS (SELECT page, size, count(*) AS n, min(pos) AS a, max(pos) AS b FROM low{name} GROUP BY page, size, run
), best{name} AS (SELECT * FROM runs{name} QUALIFY row_number() OVER (PARTITION BY page ORDER BY n DESC, a) = 1
), cut{name} AS (SELECT page, size, CAST((a + b) // 2 AS INT) AS split, CAST(floor(size * 0.01) AS INT) AS pad FROM best{name} WHERE n >= greatest(3, floor(size * 0.03))
), parts{name} AS (SELECT *, greatest(0, split - pad) AS e1, least(size, split + pad) AS s2 FROM cut{name}
), halves{name} AS (
  SELECT page, size, split, CASE WHEN e1 > 10 THEN 0 END AS start_1, CASE WHEN e1 > 10 THEN e1 END AS size_1, CASE WHEN size - s2 > 10 THEN s2 END AS start_2, CASE WHEN size - s2 > 10 THEN size - s2 END AS size_2 FROM parts{name})"""


def _classified() -> str:
    return f"""feat AS (
  SELECT *, length(text) AS n_chars, {_hits("low", _words(_T, "residential_id"))} > 0 AS has_r, {_hits("low", _words(_T, "aadhaar"))} > 0 AS has_a,
    {_hits("low", _words(_S, "front"))} > 0 AS has_f, {_hits("low", _words(_S, "back"))} > 0 AS has_b,
    2 * {_hits("low", _words(_T, "residential_id", "en"))} AS r_en, 2 * {_hits("low", _words(_T, "aadhaar", "en"))} AS a_en,
    2.0 * {_hits("low", _words(_S, "front", "en"))} AS f_en, 2.0 * {_hits("low", _words(_S, "back", "en"))} AS b_en,
    CASE WHEN ocr BETWEEN 30 AND 70 THEN 1.5 ELSE 1.0 END::DOUBLE AS mul, {_hits("low", fixed.STRONG_FRONT)} > 0 AS strong_f, {_hits("low", fixed.STRONG_BACK)} > 0 AS strong_b FROM seg
), points AS (
  SELECT *, CASE WHEN has_r THEN r_en + 3 ELSE 0 END AS r_score, CASE WHEN has_a THEN a_en + 3 ELSE 0 END AS a_score,
    (f_en + CASE WHEN has_f THEN 3 ELSE 0 END)::DOUBLE * mul AS front_points, (b_en + CASE WHEN has_b THEN 3 ELSE 0 END)::DOUBLE * mul AS back_points FROM feat
), typed AS (
  SELECT *, greatest(r_score, a_score)::BIGINT AS type_score, CASE WHEN r_score = 0 AND a_score = 0 THEN 'unknown' WHEN r_score >= a_score THEN 'residential_id' ELSE 'aadhaar' END AS doc_type,
    CASE WHEN front_points > 0 AND back_points > 0 THEN
      CASE WHEN abs(front_points - back_points) / greatest(front_points, back_points) * 100 > 10 THEN CASE WHEN front_points > back_points THEN 'front' ELSE 'back' END
        WHEN strong_b AND NOT strong_f THEN 'back' ELSE 'front' END
      WHEN front_points > 0 THEN 'front' WHEN back_points > 0 THEN 'back' ELSE 'unknown' END AS doc_side FROM points
), based AS (
  SELECT *, greatest(0, least(100, ocr * 0.3::DOUBLE
    + CASE WHEN doc_type = 'residential_id' AND has_r OR doc_type = 'aadhaar' AND has_a THEN 30 ELSE 0 END
    + CASE WHEN doc_side = 'front' AND has_f OR doc_side = 'back' AND has_b THEN 25 ELSE 0 END
    + CASE WHEN ink BETWEEN 0.05 AND 0.8 THEN 15 WHEN ink < 0.01 THEN -20 WHEN ink > 0.9 THEN -10 ELSE 0 END
    + CASE WHEN n_chars BETWEEN 50 AND 2000 THEN 10 WHEN n_chars = 0 THEN -30 ELSE 0 END))::DOUBLE AS base FROM typed
), looked AS (
  SELECT *, length(text) - length(replace(text, '<', '')) AS angles, {_hits("low", fixed.BACK_PHRASES)} AS back_score, {_hits("low", fixed.FRONT_PHRASES)} AS front_score FROM based
), sided AS (
  SELECT *, CASE WHEN angles >= 5 OR back_score > 0 AND back_score >= front_score THEN 'back' WHEN front_score > back_score THEN 'front' ELSE doc_side END AS side,
    CASE WHEN angles >= 5 THEN 'mrz_pattern' WHEN back_score > 0 AND back_score >= front_score THEN 'back_keywords' WHEN front_score > back_score THEN 'front_keywords' END AS method FROM looked
)"""


def _adjusted() -> str:
    def weight(w: str) -> int:
        return min(3, len(w.split()))

    words = ", ".join(f"({_q(t)}, {_q(w)}, {weight(w)})" for t in _T for w in _words(_T, t))
    return f"""kw(t, word, weight) AS (VALUES {words}
), filewords AS (
  SELECT DISTINCT s.file, kw.t, kw.word, kw.weight FROM seg s JOIN kw ON contains(s.low, lower(kw.word))
), spec AS (
  SELECT file, sum(weight) FILTER (WHERE t = 'residential_id') AS r_spec, sum(weight) FILTER (WHERE t = 'aadhaar') AS a_spec FROM filewords GROUP BY file
), cnt AS (
  SELECT file, count(*) FILTER (WHERE has_r) AS r_n, count(*) FILTER (WHERE has_a) AS a_n FROM feat GROUP BY file
), merged AS (
  SELECT s.*, greatest(CASE WHEN has_r THEN r_n ELSE 0 END, CASE WHEN has_a THEN a_n ELSE 0 END) AS cross_n, has_r::INT + has_a::INT + has_f::INT + has_b::INT AS matched,
    least(10, (CASE WHEN has_r THEN coalesce(r_spec, 0) ELSE 0 END + CASE WHEN has_a THEN coalesce(a_spec, 0) ELSE 0 END))::DOUBLE AS specificity,
    (CASE WHEN ocr < 30 THEN 0.5 WHEN ocr < 50 THEN 0.75 ELSE 1.0 END)::DOUBLE * (CASE WHEN ink < 0.05 OR ink > 0.8 THEN 0.8 ELSE 1.0 END)::DOUBLE AS quality
  FROM sided s JOIN cnt USING (file) LEFT JOIN spec USING (file)
), boosted AS (
  SELECT *, (CASE WHEN cross_n >= 3 THEN 15 WHEN cross_n = 2 THEN 10 WHEN cross_n = 1 THEN 5 ELSE 0 END)::DOUBLE AS boost, (CASE WHEN matched >= 3 THEN 5 WHEN matched = 2 THEN 3 ELSE 0 END)::DOUBLE AS consistency FROM merged
), adjusted AS (
  SELECT *, (boost + specificity + consistency) * quality AS adjustment, least(100, base + (boost + specificity + consistency) * quality)::DOUBLE AS confidence FROM boosted
)"""


def _paired() -> str:
    return """both_of AS (
  SELECT a.*, b.doc_type AS o_type, b.side AS o_side, b.angles AS o_angles, b.front_score + b.back_score + a.front_score + a.back_score AS phrases, b.seg IS NOT NULL AS two
  FROM adjusted a LEFT JOIN adjusted b ON a.file = b.file AND a.page = b.page AND a.seg <> b.seg
), paired AS (
  SELECT file, page, seg, doc_id, method,
    CASE WHEN two AND doc_type = 'unknown' AND o_type <> 'unknown' THEN o_type WHEN two AND doc_type = 'unknown' AND phrases > 0 THEN 'residential_id' ELSE doc_type END AS doc_type,
    CASE WHEN two AND doc_type = 'unknown' AND o_type <> 'unknown' THEN greatest(confidence, 65) ELSE confidence END AS confidence,
    CASE WHEN two AND side = 'unknown' AND o_side = 'front' THEN 'back' WHEN two AND side = 'unknown' AND o_side = 'back' THEN 'front'
      WHEN two AND side = 'back' AND o_side = 'back' AND angles < 5 AND o_angles >= 5 THEN 'front' ELSE side END AS doc_side,
    CASE WHEN two AND side = 'unknown' AND o_side = 'front' THEN 'paired_front_back' WHEN two AND side = 'unknown' AND o_side = 'back' THEN 'paired_back_front'
      WHEN two AND side = 'back' AND o_side = 'back' AND angles < 5 AND o_angles >= 5 THEN 'mrz_side_correction'
      WHEN two AND doc_type = 'unknown' AND o_type <> 'unknown' THEN 'matched_with_pair' END AS heuristic
  FROM both_of
), found AS (SELECT * REPLACE (round(confidence, 6) AS confidence) FROM paired)"""


def _kw_rows() -> str:
    rows = [(c, k, lang, w) for c, table in (("document_types", _T), ("document_sides", _S)) for k in table for lang, ws in table[k]["keywords"].items() for w in ws]
    return "dim(category, key, lang, keyword) AS (VALUES " + ", ".join("(" + ", ".join(map(_q, r)) + ")" for r in rows) + ")"


SCORES = PAGES + """, scores AS (
  SELECT ['valid-pdfs', 'italian_ids', 'unclear-pdfs', 'empty-pdfs', 'big-pdf-but-readable'][CAST(page % 5 + 1 AS INT)] AS category, file, page, ocr AS confidence FROM pg)"""

CANDIDATES = """cand AS (
  SELECT DISTINCT l_orderkey AS page, CAST(l_linenumber AS INT) AS idx, CAST((l_orderkey * 7 + l_linenumber * 83) % 450 AS INT) AS x, CAST((l_orderkey * 3 + l_linenumber * 61) % 320 AS INT) AS y,
    CAST(80 + (l_orderkey + l_linenumber * 5) % 5 * 20 AS INT) AS w, CAST(40 + (l_orderkey * 2 + l_linenumber) % 4 * 20 AS INT) AS h FROM lineitem)"""

_BOX = "{'x': x, 'y': y, 'w': w, 'h': h}"
_IOU = "(greatest(0, least(b.x + b.w, k.x + k.w) - greatest(b.x, k.x)) * greatest(0, least(b.y + b.h, k.y + k.h) - greatest(b.y, k.y)))"
_UNION = f"(b.w * b.h + k.w * k.h - {_IOU})"
_TOUCH = "(b.x + b.w >= k.x AND k.x + k.w >= b.x AND b.y + b.h >= k.y AND k.y + k.h >= b.y)"
_NAMED = "array_to_string(list_transform({}, lambda b: b.x || ':' || b.y || ':' || b.w || ':' || b.h), ' ')"


def _fold(boxes: str, clash: str) -> str:
    """Keeps boxes in order unless they clash with a kept one."""
    return f"list_reduce(list_transform({boxes}, lambda b: [b]), lambda kept, one: CASE WHEN len(list_filter(kept, lambda k: list_contains(list_transform(one, lambda b: {clash}), true))) > 0 THEN kept ELSE list_concat(kept, one) END)"


_SUPPRESS = f"({_TOUCH} OR ({_UNION} > 0 AND {_IOU} / {_UNION} > 0.3))"
_COVER = "(least(b.x + b.w, k.x + k.w) > greatest(b.x, k.x) AND least(b.y + b.h, k.y + k.h) > greatest(b.y, k.y) AND (least(b.x + b.w, k.x + k.w) - greatest(b.x, k.x)) * (least(b.y + b.h, k.y + k.h) - greatest(b.y, k.y)) > greatest(b.w * b.h, k.w * k.h) * 0.1)"

#: Vertical repair, box after box: a recursion over the places of a page's sorted boxes that carries the box moved last.
_REPAIR = """sorted AS (
  SELECT page, row_number() OVER (PARTITION BY page ORDER BY y, ord) AS i, count(*) OVER (PARTITION BY page) AS n, x, y, w, h FROM {src}
), walk AS (
  SELECT page, i, n, x, y, w, h, NULL::INT AS px, NULL::INT AS py, NULL::INT AS pw, NULL::INT AS ph FROM sorted WHERE i = 1
  UNION ALL
  SELECT s.page, s.i, s.n, s.x, CASE WHEN k.y + k.h > s.y THEN k.y + k.h - (k.y + k.h - s.y) // 2 ELSE s.y END,
    s.w, CASE WHEN k.y + k.h > s.y THEN s.y + s.h - (k.y + k.h - (k.y + k.h - s.y) // 2) ELSE s.h END,
    k.x, k.y, k.w, CASE WHEN k.y + k.h > s.y THEN k.h - (k.y + k.h - s.y) // 2 ELSE k.h END
  FROM walk k JOIN sorted s ON s.page = k.page AND s.i = k.i + 1
), parted AS (
  SELECT page, i - 1 AS i, n, px AS x, py AS y, pw AS w, ph AS h FROM walk WHERE i > 1
  UNION ALL SELECT page, i, n, x, y, w, h FROM walk WHERE i = n
), clamped AS (
  SELECT page, i, n, CASE WHEN n = 1 THEN x ELSE greatest(0, least(x, 599)) END AS x, CASE WHEN n = 1 THEN y ELSE greatest(0, least(y, 399)) END AS y, w, h FROM parted WHERE n = 1 OR (w > 20 AND h > 20)
), final AS (
  SELECT page, i, x, y, CASE WHEN n = 1 THEN w ELSE least(x + w, 600) - x END AS w, CASE WHEN n = 1 THEN h ELSE least(y + h, 400) - y END AS h FROM clamped
)
SELECT p.page, coalesce(string_agg(f.x || ':' || f.y || ':' || f.w || ':' || f.h, ' ' ORDER BY f.i), '') AS {name} FROM (SELECT DISTINCT page FROM sorted) p LEFT JOIN final f ON p.page = f.page GROUP BY p.page"""


def oracle_sql() -> dict[str, str]:
    aug = lambda cols: f"WITH {AUG} SELECT doc_id, {cols} FROM aug"
    kinds = ", ".join(f"CASE WHEN regexp_matches(text, {_q(p)}, {_q('' if case else 'i')}) THEN {_q(name)} END" for name, p, case in fixed.ARTIFACT_KINDS)
    escaped = "replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
    intended = [r"[A-Za-z]:\\[^\s]+" if p.startswith(r"[A-Za-z]:\\") else p.replace("\\\\", "\\") for p in fixed.TEXT_ARTIFACTS]
    cleaned = r"regexp_replace(text, '[?\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{FFFD}]', '', 'g')"
    for p, by in (("•{4,}", ""), (" {2,}", " "), (r"\t+", " "), (r"\n{3,}", "\n")):
        cleaned = f"regexp_replace({cleaned}, '{p}', {_q(by)}, 'g')"
    cl, ad, pa = _classified(), _adjusted(), _paired()
    side_names = "CASE p.side " + " ".join(f"WHEN {_q(k)} THEN {_q(v['display_name'])}" for k, v in _S.items()) + " ELSE 'Unknown' END"
    out = {
        "language_verdicts": f"""SELECT language, readable, count(*) AS n_pages, round(avg(ocr), 6) AS avg_confidence FROM (
  SELECT {_language("text")} AS language, (doc_id * 7 % 1001)::DOUBLE / 10 AS ocr, (doc_id * 7 % 1001)::DOUBLE / 10 >= 15 AS readable FROM documents) GROUP BY ALL""",
        "clean_text": aug(f"array_to_string(list_filter(list_transform(string_split({cleaned}, chr(10)), lambda l: {_strip('l')}), lambda l: l <> ''), chr(10)) AS cleaned"),
        "filter_artifacts": aug(f"{_strip(_cut('text', fixed.TEXT_ARTIFACTS))} AS filtered"),
        "filter_artifacts_intended": aug(f"{_strip(_cut('text', intended))} AS filtered"),
        "filter_for_confidence": f"""WITH {AUG}, lines AS (
  SELECT doc_id, list_transform(string_split({_strip(_cut("text", fixed.TEXT_ARTIFACTS))}, '\\n'), lambda l: {_strip("l")}) AS ls FROM aug
) SELECT doc_id, array_to_string(list_filter(ls, lambda l: l <> '' AND NOT length(regexp_replace(l, '[^\\p{{L}}]', '', 'g')) / length(l) < 0.3
    AND NOT (regexp_matches(l, '^[\\\\d\\\\s\\\\W]+$') AND length(l) < 10)), '\\n') AS filtered FROM lines""",
        "has_artifacts": aug(" OR ".join(f"regexp_matches(text, {_q(p)}, 'i')" for p in fixed.TEXT_ARTIFACTS) + " AS found"),
        "artifact_types": aug(f"array_to_string(list_filter([{kinds}], lambda k: k IS NOT NULL), '; ') AS kinds"),
        "box_artifacts": aug(" OR ".join(f"regexp_matches(text, {_q(p)}, 'i')" for p in fixed.BOX_ARTIFACTS) + " AS found"),
        "detect_language": aug(f"{_language('text')} AS language"),
        "html_escape": aug(f"CASE WHEN text = '' THEN '(No text detected)' ELSE {escaped} END AS escaped"),
        "preview": aug("CASE WHEN text = '' THEN '(No text)' WHEN length(text) > 40 THEN replace(replace(substr(text, 1, 40) || '...', chr(10), ' '), chr(13), '') ELSE replace(replace(text, chr(10), ' '), chr(13), '') END AS short"),
        "key_values": f"""WITH {AUG}, lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM aug
), pairs AS (
  SELECT doc_id, n, regexp_extract(line, '^([^:]+):(.+)$', 1) AS k, regexp_extract(line, '^([^:]+):(.+)$', 2) AS v FROM lines WHERE regexp_matches(line, '^[^:]+:.+$')
  UNION ALL SELECT doc_id, n, regexp_extract(line, '^([^-]+)-(.+)$', 1), regexp_extract(line, '^([^-]+)-(.+)$', 2) FROM lines WHERE NOT regexp_matches(line, '^[^:]+:.+$') AND regexp_matches(line, '^[^-]+-.+$')
), bare AS (SELECT doc_id, n, {_strip("k")} AS key, {_strip("v")} AS value FROM pairs)
SELECT doc_id, key, arg_max(value, n) AS value FROM bare GROUP BY doc_id, key
UNION ALL SELECT doc_id, 'line_' || n, {_strip("line")} FROM lines WHERE doc_id NOT IN (SELECT doc_id FROM pairs) AND {_strip("line")} <> ''""",
        "text_features": f"""WITH {AUG} SELECT doc_id, length(text)::INT AS n_chars, CASE WHEN {_strip("text")} = '' THEN 0 ELSE len(string_split_regex({_strip("text")}, '{_WS}+')) END::INT AS n_words,
  (length(text) - length(replace(text, '<', '')))::INT AS mrz_score, length(text) - length(replace(text, '<', '')) >= 5 AS has_mrz,
  {_hits("lower(text)", fixed.BACK_PHRASES)}::INT AS back_score, {_hits("lower(text)", fixed.FRONT_PHRASES)}::INT AS front_score, contains(lower(text), 'firma') OR contains(lower(text), 'signature') AS signed FROM aug""",
        "html_fragments": aug("'<h3>Page ' || page || '</h3><div>' || replace(text, chr(10), '<br>') || '</div>' AS html, CAST(page AS VARCHAR) AS page_key"),
        "box_conf_all": f"WITH {BOXES} SELECT doc_id, round(avg(CASE WHEN filled THEN c ELSE 0 END), 6) AS mean_conf, count(*) AS n_boxes FROM box GROUP BY doc_id",
        "box_conf_weighted": f"WITH {BOXES} SELECT doc_id, round(avg(CASE WHEN filled THEN c ELSE 0 END), 6) AS overall_conf, round(coalesce(avg(c) FILTER (WHERE filled), 0), 6) AS text_conf, count(*) FILTER (WHERE filled) AS text_boxes, count(*) AS n_boxes FROM box GROUP BY doc_id",
        "box_conf_filtered": f"""WITH {BOXES} SELECT doc_id, round(coalesce(avg(c) FILTER (WHERE filled AND NOT artifact), 0), 6) AS filtered_conf, round(coalesce(avg(c) FILTER (WHERE filled), 0), 6) AS total_conf,
  round(coalesce(avg(c) FILTER (WHERE filled AND NOT artifact), 0), 6) AS text_conf, count(*) FILTER (WHERE filled AND NOT artifact) AS filtered_boxes, count(*) AS n_boxes, bool_or(filled AND artifact) AS has_artifacts FROM box GROUP BY doc_id""",
        "page_conf_fast": f"WITH {BOXES} SELECT doc_id, round(coalesce(avg(c) FILTER (WHERE filled AND NOT artifact), 0), 6) AS score FROM box GROUP BY doc_id",
        "page_conf_balanced": f"""WITH {BOXES}, modes AS (
  SELECT doc_id, avg(CASE WHEN filled THEN greatest(coalesce(TRY_CAST(conf AS INT) // 5, 0), 0) ELSE 0 END) AS b, avg(CASE WHEN filled THEN greatest(coalesce(TRY_CAST(conf AS INT) // 3, 0), 0) ELSE 0 END) AS e FROM box GROUP BY doc_id
) SELECT doc_id, round(b, 6) AS balanced, round(e, 6) AS enhanced, round(CASE WHEN b < 10 THEN greatest(b, e) ELSE b END, 6) AS score FROM modes""",
        "page_conf_by_language": f"WITH {BOXES} SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 0.0::DOUBLE ELSE round(avg(CASE WHEN filled THEN c ELSE 0 END), 6) END AS score FROM box GROUP BY doc_id",
        "filter_delta": f"""WITH {BOXES}, m AS (
  SELECT doc_id, avg(CASE WHEN filled THEN c ELSE 0 END) AS o, coalesce(avg(c) FILTER (WHERE filled AND NOT artifact), 0) AS f, count(*) - count(*) FILTER (WHERE filled AND NOT artifact) AS artifact_boxes, bool_or(filled AND artifact) AS has_artifacts FROM box GROUP BY doc_id
) SELECT doc_id, round(o, 6) AS overall_conf, round(f, 6) AS filtered_conf, artifact_boxes, has_artifacts, round(f - o, 6) AS delta, CASE WHEN round(f - o, 6) > 0 THEN 'IMPROVED' ELSE 'SAME/LOWER' END AS effect FROM m""",
        "best_method": f"""WITH {AUG}, s AS (SELECT doc_id, (doc_id * 3 % 7)::DOUBLE AS a, (doc_id * 5 % 7)::DOUBLE AS b, (doc_id % 7)::DOUBLE AS c, (doc_id * 2 % 7)::DOUBLE AS d FROM aug)
SELECT doc_id, greatest(a, b, c, d) AS best_score, CASE greatest(a, b, c, d) WHEN a THEN 'improved_eng' WHEN b THEN 'improved_ita' WHEN c THEN 'original_eng' ELSE 'original_ita' END AS best_method FROM s""",
        "classify_type": f"WITH {SEG}, {cl} SELECT doc_id, doc_type, type_score FROM typed",
        "classify_side": f"WITH {SEG}, {cl} SELECT doc_id, doc_side, front_points, back_points FROM typed",
        "base_confidence": f"WITH {SEG}, {cl} SELECT doc_id, doc_type, doc_side, round(base, 6) AS base_confidence FROM based",
        "content_side": f"WITH {SEG}, {cl} SELECT doc_id, side AS doc_side, method AS detection_method FROM sided",
        "keyword_hits": f"WITH {SEG}, {_kw_rows()} SELECT doc_id, category, key, lang, keyword FROM seg JOIN dim ON contains(low, lower(keyword))",
        "keyword_frequency": f"""WITH {SEG}, {_kw_rows()}, hit AS (SELECT file, page, seg, category, key, keyword FROM seg JOIN dim ON contains(low, lower(keyword))
), places AS (SELECT file, category, key, string_agg(page || '-' || seg, ',' ORDER BY page, seg) AS pages, count(*) AS n_segments FROM (SELECT DISTINCT file, category, key, page, seg FROM hit) GROUP BY ALL
), named AS (SELECT file, category, key, string_agg(keyword, ',' ORDER BY keyword) AS keywords FROM (SELECT DISTINCT file, category, key, keyword FROM hit) GROUP BY ALL)
SELECT file, category, key, n_segments, pages, keywords FROM places JOIN named USING (file, category, key)""",
        "keyword_counts": f"WITH {SEG}, {_kw_rows()} SELECT file, keyword, count(*) AS n FROM seg JOIN dim ON contains(low, lower(keyword)) WHERE category = 'document_types' GROUP BY file, keyword",
        "conf_adjustment": f"""WITH {SEG}, {cl}, {ad} SELECT doc_id, cross_n AS cross_document_matches, matched AS matched_keyword_count, round(boost, 6) AS frequency_boost, round(specificity, 6) AS specificity_bonus,
  round(consistency, 6) AS consistency_bonus, round(quality, 6) AS quality_factor, round(adjustment, 6) AS total_adjustment, round(confidence, 6) AS confidence,
  CASE WHEN round(adjustment, 6) > 10 THEN 'strong' WHEN round(adjustment, 6) > 5 THEN 'moderate' ELSE 'slight' END AS band FROM adjusted""",
        "matched_categories": f"WITH {SEG}, {cl} SELECT doc_id, concat_ws(',', CASE WHEN has_r THEN 'residential_id' END, CASE WHEN has_a THEN 'aadhaar' END, CASE WHEN has_f THEN 'front' END, CASE WHEN has_b THEN 'back' END) AS matched FROM feat",
        "pairing": f"WITH {SEG}, {cl}, {ad}, {pa} SELECT file, page, seg, doc_type, doc_side, confidence, method AS detection_method, heuristic AS heuristic_applied FROM found",
        "type_groups": f"WITH {SEG}, {cl}, {ad}, {pa} SELECT file, doc_type AS bucket, count(*) AS n_segments, round(avg(confidence), 6) AS avg_confidence FROM found GROUP BY file, doc_type",
        "best_id_per_page": f"""WITH {SEG}, {cl}, {ad}, {pa}, p AS (
  SELECT file, page, confidence, doc_side AS side FROM found WHERE doc_type = 'residential_id' QUALIFY row_number() OVER (PARTITION BY file, page ORDER BY confidence DESC, seg) = 1
) SELECT a.file, a.page, coalesce(p.confidence >= 50, false) AS present, p.confidence, p.side,
  CASE WHEN p.confidence >= 50 THEN 'National ID — ' || {side_names} || ' (' || printf('%.1f', p.confidence) || '%)' ELSE 'None detected' END AS detection
FROM (SELECT DISTINCT file, page FROM found) a LEFT JOIN p USING (file, page)""",
        "emphasised_segments": f"""WITH {SEG}, {cl}, {ad}, {pa}, shown AS (SELECT * FROM found WHERE doc_id % 19 <> 0 AND confidence >= 30)
SELECT file, page, seg, doc_type = 'residential_id' AND row_number() OVER (PARTITION BY file, page, doc_type = 'residential_id' ORDER BY confidence DESC, seg) = 1 AS emphasis,
  CASE WHEN confidence >= 85 THEN 'green' WHEN confidence >= 70 THEN 'orange' ELSE 'red' END AS band FROM shown""",
        "segment_labels": f"""WITH {SEG}, {cl}, {ad}, {pa}, t(k, label, name, color) AS (VALUES {", ".join(f"({_q(k)}, {_q(v['label'])}, {_q(v['display_name'])}, {_q(','.join(map(str, v['color'])))})" for k, v in _T.items())}
), s(k, name, code) AS (VALUES {", ".join(f"({_q(k)}, {_q(v['display_name'])}, {_q(v['label'])})" for k, v in _S.items())}
), j AS (SELECT f.*, coalesce(t.label, upper(doc_type)) AS type_label, coalesce(t.name, upper(doc_type)) AS type_name, coalesce(t.color, '128,128,128') AS color, coalesce(s.name, upper(doc_side)) AS side_name, coalesce(s.code, upper(doc_side[1])) AS side_code
  FROM found f LEFT JOIN t ON doc_type = t.k LEFT JOIN s ON doc_side = s.k)
SELECT file, page, seg, type_label, type_name, color, side_name, side_code, type_name || ' - ' || side_name || ' (' || printf('%.1f', confidence) || '%)' AS label FROM j""",
        "page_validity": f"""WITH {PAGES} SELECT folder, file, page, ink * 100 < 0.05::DOUBLE * 100 AS is_empty, ocr >= 30 AS is_readable,
  CASE WHEN ink * 100 < 0.05::DOUBLE * 100 OR ocr < 30 THEN 'Invalid' ELSE 'Valid' END AS status, CASE WHEN ink * 100 < 0.05::DOUBLE * 100 THEN 'Empty page' WHEN ocr < 30 THEN 'Low readability' ELSE 'OK' END AS reason FROM pg""",
        "validity_table": f"""WITH {PAGES} SELECT file, page, CASE WHEN ink * 100 < 0.05::DOUBLE * 100 OR ocr < 30 THEN 'Invalid' ELSE 'Valid' END AS status, printf('%.2f', ink * 100) AS ink, printf('%.2f', ocr) AS conf,
  CASE WHEN ink * 100 < 0.05::DOUBLE * 100 THEN 'Yes' ELSE 'No' END AS is_empty, CASE WHEN ocr >= 30 THEN 'Yes' ELSE 'No' END AS is_readable,
  CASE WHEN ink * 100 < 0.05::DOUBLE * 100 THEN 'Empty page' WHEN ocr < 30 THEN 'Low readability' ELSE 'OK' END AS reason FROM pg""",
        "validity_counts": f"WITH {PAGES} SELECT count(*) AS total, count(*) FILTER (WHERE NOT (ink * 100 < 0.05::DOUBLE * 100 OR ocr < 30)) AS valid, count(*) FILTER (WHERE ink * 100 < 0.05::DOUBLE * 100 OR ocr < 30) AS invalid FROM pg",
        "readability": f"WITH {PAGES} SELECT folder, file, page, ocr >= 15 AS readable, ink * 100 < 0.5 AS empty, round(ink * 100, 6) AS ink_percent FROM pg",
        "conf_band": f"WITH {PAGES} SELECT CASE WHEN ocr >= 50 THEN 'high' WHEN ocr >= 30 THEN 'medium' ELSE 'low' END AS band, CASE WHEN ocr >= 85 THEN 'green' WHEN ocr >= 70 THEN 'orange' ELSE 'red' END AS display, count(*) AS n FROM pg GROUP BY ALL",
        "report_rollup": f"""WITH {PAGES}, r AS (SELECT folder, file, ocr, ocr >= 15 AS ok, ink * 100 < 0.5 AS void FROM pg)
SELECT CASE WHEN grouping(folder) = 1 THEN 'all' WHEN grouping(file) = 1 THEN 'folder' ELSE 'file' END AS level, folder, file, count(*) AS total, count(*) FILTER (WHERE ok) AS readable, count(*) FILTER (WHERE NOT ok) AS unreadable,
  count(*) FILTER (WHERE void) AS empty, round(avg(ocr), 6) AS avg_confidence, round(100.0::DOUBLE * count(*) FILTER (WHERE ok) / count(*), 1) AS readable_percent,
  round(100.0::DOUBLE * count(*) FILTER (WHERE NOT ok) / count(*), 1) AS unreadable_percent, round(100.0::DOUBLE * count(*) FILTER (WHERE void) / count(*), 1) AS empty_percent FROM r GROUP BY ROLLUP (folder, file)""",
        "report_files": f"WITH {PAGES} SELECT count(DISTINCT (folder, file)) AS by_folder_and_name, count(DISTINCT file) AS by_name FROM pg",
        "report_nesting": f"WITH {PAGES} SELECT folder, file, count(*)::INT AS n, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS pages FROM pg GROUP BY folder, file",
        "timing_sums": f"WITH {PAGES} SELECT sum(page % 97)::BIGINT AS total_extraction_ms, sum(page % 31)::BIGINT AS total_clarity_ms FROM pg",
        "category_stats": f"""WITH {SCORES} SELECT category, count(*) AS n, min(confidence) AS min_confidence, max(confidence) AS max_confidence, round(avg(confidence), 6) AS avg_confidence, count(*) FILTER (WHERE confidence >= 30) AS n_readable,
  round(100.0::DOUBLE * count(*) FILTER (WHERE confidence >= 30) / count(*), 1) AS readable_percent FROM scores GROUP BY category""",
        "percentiles": f"""WITH {SCORES}, placed AS (SELECT confidence, row_number() OVER (ORDER BY confidence) - 1 AS spot, count(*) OVER () AS n FROM scores)
SELECT p::INT AS percentile, confidence AS value FROM placed JOIN (VALUES (10), (25), (50), (75), (90)) v(p) ON spot = n * p // 100""",
        "threshold_sweep": f"""WITH {SCORES} SELECT t::INT AS threshold, count(*) FILTER (WHERE confidence >= t) AS n_readable, count(*) FILTER (WHERE confidence < t) AS n_unreadable, round(100.0::DOUBLE * count(*) FILTER (WHERE confidence >= t) / count(*), 1) AS readable_percent,
  CASE WHEN t <= 10 THEN 'Too lenient - accepts blank pages' WHEN t <= 20 THEN 'Good for Italian IDs & degraded docs' WHEN t <= 30 THEN 'Balanced - recommended for mixed docs' WHEN t <= 40 THEN 'Strict - only clear documents pass' ELSE 'Very strict - only excellent quality' END AS advice
FROM scores, (VALUES (5), (10), (15), (20), (25), (30), (35), (40), (50)) v(t) GROUP BY t""",
        "pass_rates": f"""WITH {SCORES}, r AS (SELECT *, CASE WHEN contains(category, 'empty') THEN 5 WHEN contains(category, 'valid') THEN 25 WHEN contains(category, 'italian') THEN 15 WHEN contains(category, 'unclear') THEN 10 ELSE 20 END AS threshold FROM scores)
SELECT category, threshold::INT AS threshold, round(avg(confidence), 6) AS avg_confidence, count(*) FILTER (WHERE confidence >= threshold) AS n_passing, count(*) AS n FROM r GROUP BY category, threshold""",
        "first_files": f"WITH {SCORES} SELECT category, file FROM (SELECT DISTINCT category, file FROM scores) QUALIFY row_number() OVER (PARTITION BY category ORDER BY file) <= 5",
        "top_keywords": f"""WITH {SEG}, {_kw_rows()}, hit AS (SELECT DISTINCT file, key, keyword FROM seg JOIN dim ON contains(low, lower(keyword)))
SELECT file, key, string_agg(keyword, ',' ORDER BY keyword) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY file, key ORDER BY keyword) AS n FROM hit) WHERE n <= 10 GROUP BY file, key""",
        "segment_pages": f"WITH {SEG} SELECT file, page || '-' || seg AS page_key, count(*) OVER w AS n_segments, max(ink) OVER w AS max_ink FROM seg WINDOW w AS (PARTITION BY file, page)",
        "first_page": f"WITH {SEG} SELECT file, page, seg, doc_id FROM seg QUALIFY row_number() OVER (PARTITION BY file, page ORDER BY seg) = 1",
        "config_keywords": f"WITH {_kw_rows()} SELECT category, key, lang, count(*) AS n, sum(len(string_split(keyword, ' ')))::BIGINT AS n_words FROM dim GROUP BY category, key, lang",
        "ink_ratio": """WITH v AS (SELECT vec_id, embedding, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi FROM embeddings
), img AS (
  SELECT vec_id, 0 AS kind, unnest(list_transform(embedding, lambda x: CASE WHEN hi > lo THEN floor((x::DOUBLE - lo) / (hi - lo) * 255)::INT ELSE 0 END)) AS px FROM v
  UNION ALL SELECT vec_id, 1, unnest(list_transform(embedding, lambda x: (vec_id % 256)::INT)) FROM v
  UNION ALL SELECT vec_id, 2, unnest(list_transform(range(len(embedding)), lambda i: CASE WHEN i % 4 = 0 THEN 10 ELSE 200 END)) FROM v
), hist AS (SELECT vec_id, kind, px, count(*) AS n FROM img GROUP BY ALL
), cum AS (
  SELECT *, sum(n) OVER w AS n1, sum(px * n) OVER w AS s1, sum(n) OVER (PARTITION BY vec_id, kind) AS total, sum(px * n) OVER (PARTITION BY vec_id, kind) AS s FROM hist WINDOW w AS (PARTITION BY vec_id, kind ORDER BY px)
), spread AS (SELECT *, CASE WHEN n1 < total THEN (total * s1 - n1 * s)::DOUBLE * (total * s1 - n1 * s)::DOUBLE / (n1 * (total - n1))::DOUBLE ELSE 0 END AS sp FROM cum
), best AS (SELECT * FROM spread WHERE sp > 0 QUALIFY row_number() OVER (PARTITION BY vec_id, kind ORDER BY sp DESC, px) = 1)
SELECT h.vec_id, h.kind, coalesce(any_value(b.px), 0)::INT AS threshold, round(coalesce(any_value(b.n1), sum(h.n) FILTER (WHERE h.px = 0), 0)::DOUBLE / sum(h.n)::DOUBLE, 6) AS ink_ratio FROM hist h LEFT JOIN best b USING (vec_id, kind) GROUP BY h.vec_id, h.kind""",
        "box_geometry": f"""WITH {CANDIDATES}, p AS (SELECT *, trunc(w * 0.08::DOUBLE)::INT AS dx, trunc(h * 0.08::DOUBLE)::INT AS dy FROM cand)
SELECT page, idx, w * h > 240000 * 0.02 AND w * h < 240000 * 0.95 AND w::DOUBLE / h > 1.2 AND w::DOUBLE / h < 2.5 AS document_sized, greatest(0, x - dx) AS x, greatest(0, y - dy) AS y,
  least(600, x + w + dx) - greatest(0, x - dx) AS w, least(400, y + h + dy) - greatest(0, y - dy) AS h FROM p""",
        "box_overlaps": f"""WITH {CANDIDATES}, nx AS (SELECT b.page, b.idx, b, k FROM cand b JOIN cand k ON b.page = k.page AND k.idx = b.idx + 1)
SELECT page, idx, round(CASE WHEN {_UNION} > 0 THEN {_IOU}::DOUBLE / {_UNION} ELSE 0 END, 6) AS iou, greatest(0, k.x - b.x - b.w, b.x - k.x - k.w)::INT AS gap_x, greatest(0, k.y - b.y - b.h, b.y - k.y - k.h)::INT AS gap_y FROM nx""",
        "suppress_overlaps": f"WITH {CANDIDATES}, g AS (SELECT page, list({_BOX} ORDER BY w * h DESC, idx) AS bs FROM cand GROUP BY page) SELECT page, {_NAMED.format(_fold('bs', _SUPPRESS))} AS kept FROM g",
        "drop_covered": f"WITH {CANDIDATES}, g AS (SELECT page, list({_BOX} ORDER BY y, x, idx) AS bs FROM cand GROUP BY page) SELECT page, {_NAMED.format(_fold('bs', _COVER))} AS kept FROM g",
        "split_overlaps": f"WITH RECURSIVE {CANDIDATES}, src AS (SELECT *, idx AS ord FROM cand), " + _REPAIR.format(src="src", name="kept"),
        "segment_boxes": f"""WITH RECURSIVE {CANDIDATES}, g AS (
  SELECT page, list({_BOX} ORDER BY w * h DESC, x, idx) AS bs FROM cand WHERE w * h > 240000 * 0.02 AND w * h < 240000 * 0.95 AND w::DOUBLE / h > 1.2 AND w::DOUBLE / h < 2.5 GROUP BY page
), kept AS (SELECT page, {_fold("bs", _SUPPRESS)} AS ks FROM g
), flat AS (SELECT page, unnest(ks) AS b, unnest(range(len(ks))) AS ord FROM kept
), src AS (
  SELECT page, ord, greatest(0, b.x - trunc(b.w * 0.08::DOUBLE)::INT) AS x, greatest(0, b.y - trunc(b.h * 0.08::DOUBLE)::INT) AS y,
    least(600, b.x + b.w + trunc(b.w * 0.08::DOUBLE)::INT) - greatest(0, b.x - trunc(b.w * 0.08::DOUBLE)::INT) AS w, least(400, b.y + b.h + trunc(b.h * 0.08::DOUBLE)::INT) - greatest(0, b.y - trunc(b.h * 0.08::DOUBLE)::INT) AS h FROM flat
), """ + _REPAIR.format(src="src", name="boxes"),
        "projection_split": f"WITH {_projection(0, '')} SELECT * FROM halves",
        "projection_split_columns": f"WITH {_projection(5, '')} SELECT * FROM halves",
        "segment_cascade": f"""WITH {_projection(0, "_r")}, {_projection(5, "_c")}, sized AS (
  SELECT c_custkey AS page, 60 + (c_custkey + 5) % 60 AS w, 60 + c_custkey % 60 AS h FROM customer
), told AS (
  SELECT s.page, w, h, r.start_1 AS r1, r.size_1 AS rs1, r.start_2 AS r2, r.size_2 AS rs2, c.start_1 AS c1, c.size_1 AS cs1, c.start_2 AS c2, c.size_2 AS cs2
  FROM sized s LEFT JOIN halves_r r ON s.page = r.page LEFT JOIN halves_c c ON s.page = c.page
)
SELECT page, CASE WHEN page % 4 = 0 THEN '0:0:56:34'
  WHEN r1 IS NOT NULL OR r2 IS NOT NULL THEN concat_ws(' ', '0:' || r1 || ':' || w || ':' || rs1, '0:' || r2 || ':' || w || ':' || rs2)
  WHEN c1 IS NOT NULL OR c2 IS NOT NULL THEN concat_ws(' ', c1 || ':0:' || cs1 || ':' || h, c2 || ':0:' || cs2 || ':' || h)
  ELSE '0:0:' || w || ':' || h END AS boxes,
  CASE WHEN page % 4 = 0 THEN 'contours' WHEN r1 IS NOT NULL OR r2 IS NOT NULL THEN 'rows' WHEN c1 IS NOT NULL OR c2 IS NOT NULL THEN 'columns' ELSE 'page' END AS found_by FROM told""",
        "page_groups": f"WITH {SEG} SELECT file, page, count(*) AS n_segments, string_agg(seg || ':' || doc_id, ' ' ORDER BY seg, doc_id) AS segments FROM seg GROUP BY file, page",
        "page_json": f"""WITH {PAGES}, one AS (SELECT file, page, text, '<h3>Page ' || page || '</h3><div>' || replace(text, chr(10), '<br>') || '</div>' AS html FROM pg)
SELECT file, '{{' || string_agg('"page_' || page || '":{{"text":' || to_json(text) || ',"html":' || to_json(html) || '}}', ',' ORDER BY page) || '}}' AS content FROM one GROUP BY file""",
        "key_value_json": f"""WITH {AUG}, lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM aug
), pairs AS (
  SELECT doc_id, n, regexp_extract(line, '^([^:]+):(.+)$', 1) AS k, regexp_extract(line, '^([^:]+):(.+)$', 2) AS v FROM lines WHERE regexp_matches(line, '^[^:]+:.+$')
  UNION ALL SELECT doc_id, n, regexp_extract(line, '^([^-]+)-(.+)$', 1), regexp_extract(line, '^([^-]+)-(.+)$', 2) FROM lines WHERE NOT regexp_matches(line, '^[^:]+:.+$') AND regexp_matches(line, '^[^-]+-.+$')
), bare AS (SELECT doc_id, n, {_strip("k")} AS key, {_strip("v")} AS value FROM pairs
), kept AS (SELECT doc_id, key, max(n) AS n, arg_max(value, n) AS value FROM bare GROUP BY doc_id, key
  UNION ALL SELECT doc_id, 'line_' || n, n, {_strip("line")} FROM lines WHERE doc_id NOT IN (SELECT doc_id FROM pairs) AND {_strip("line")} <> '')
SELECT a.doc_id, '{{' || coalesce(string_agg(to_json(key) || ':' || to_json(value), ',' ORDER BY n), '') || '}}' AS keys FROM aug a LEFT JOIN kept k USING (doc_id) GROUP BY a.doc_id""",
        "fit_sizes": """WITH sized AS (SELECT p_partkey, CAST(p_partkey * 37 % 1900 + 1 AS INT) AS w, CAST(p_partkey * 53 % 1300 + 1 AS INT) AS h FROM part)
SELECT p_partkey, CAST(trunc(w * least(400::DOUBLE / w, 400::DOUBLE / h, 1)) AS INT) AS fit_w, CAST(trunc(h * least(400::DOUBLE / w, 400::DOUBLE / h, 1)) AS INT) AS fit_h FROM sized""",
    }
    return out
