"""SQL of the queries in reference_queries for another engine.

The statements are written apart from the plans but take their fixed patterns and lists from the same module, so a wrong
pattern would be wrong in both. That engine's ``\\b``, ``\\w``, ``\\d`` and ``\\s`` know ASCII only. So texts are marked first: each word
character beyond ASCII stands between two underscores, which makes the borders of ASCII words those of Unicode words; ``uni``
widens the classes, and ``unmark`` takes the underscores away again.
"""

from __future__ import annotations

import re

from narravig import lexicons as lex

WORD = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}"
BLANK = r"\t-\r \x{85}\p{Z}"
WS = f"[{BLANK}]"
NO_WORD = f"[^{WORD}]+"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def mark(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '([{WORD}])', '_\1_', 'g'), '_([0-9A-Za-z_])_', '\1', 'g')"


def unmark(c: str) -> str:
    return rf"regexp_replace({c}, '_([^\x00-\x7f])_', '\1', 'g')"


def uni(pattern: str) -> str:
    """A pattern with Unicode classes, for marked texts."""
    out, inside, i = "", False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\w":
            out += rf"\w{WORD}" if inside else rf"[\w{WORD}]"
        elif two == r"\d":
            out += r"0-9\p{Nd}_" if inside else r"(?:[0-9]|_\p{Nd}_)"
        elif two == r"\s":
            out += BLANK if inside else WS
        elif two[:1] == "\\":
            out += two
        else:
            inside = two[0] == "[" or inside and two[0] != "]"
            out += two[0]
            i -= 1
        i += 2
    return out


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def hit(c: str, pattern: str, group: int = 0) -> str:
    """The first match in a marked text, or null."""
    return f"nullif({unmark(f'regexp_extract({c}, {q("(?i)" + uni(pattern))}, {group})')}, '')"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def values(words, name: str) -> str:
    return f"{name}(i, w) AS (VALUES {', '.join(f'({i}, {q(w)})' for i, w in enumerate(words))})"


N = f"n AS (SELECT *, {mark('t')} AS mt FROM (SELECT DISTINCT narrative_id, drug_name, engine, narrative AS t FROM narratives WHERE narrative IS NOT NULL))"
DL = "dl AS (SELECT DISTINCT ord, lower(name) AS name FROM drug_lex)"
RL = "rl AS (SELECT DISTINCT ord, lower(term) AS term FROM reaction_lex)"
D0 = "d0 AS (SELECT narrative_id, t, ord, name, instr(lower(t), name) - 1 AS start FROM n, dl WHERE contains(lower(t), name))"


def drugs(tail: int, name: str = "d") -> str:
    ctx = mark(f"substr(t, greatest(start - 10, 0) + 1, start + length(name) + {tail} - greatest(start - 10, 0))")
    return (
        f"{name} AS (SELECT narrative_id, ord, name, start, {hit('ctx', lex.DOSE)} AS dose, lower({hit('ctx', lex.ROUTE)}) AS route, "
        f"{strip(hit('ctx', lex.INDICATION, 1))} AS indication FROM (SELECT *, {ctx} AS ctx FROM d0))"
    )


def reactions(aware: bool, name: str = "r") -> str:
    word = r"'\b' || regexp_escape(term) || '\b'"
    if aware:
        base = f"SELECT narrative_id, t, ord, term, length({unmark(f'string_split_regex(lower(mt), {word})[1]')}) AS start FROM n, rl WHERE contains(lower(t), term) AND regexp_matches(lower(mt), {word})"
        cue = rf"(?i)\b({lex.NEGATIONS})\b"
        any_sign = r"(?:_[^\x00-\x7f]_|[^\n])"
        amount = f"{q('(?i)' + uni(lex.DOSE_BEFORE).replace('.{0,10}', any_sign + '{0,10}'))} || regexp_escape(term)"
        guard = (
            f"WHERE NOT regexp_matches({mark('substr(t, greatest(start - 60, 0) + 1, start - greatest(start - 60, 0))')}, {q(cue)}) "
            f"AND NOT regexp_matches({mark('substr(t, greatest(start - 40, 0) + 1, start + length(term) + 40 - greatest(start - 40, 0))')}, {amount})"
        )
    else:
        base, guard = "SELECT narrative_id, t, ord, term, instr(lower(t), term) - 1 AS start FROM n, rl WHERE contains(lower(t), term)", ""
    ctx = mark("substr(t, greatest(start - 30, 0) + 1, start + length(term) + 80 - greatest(start - 30, 0))")
    return f"""{name}0 AS ({base}),
{name}1 AS (SELECT *, {ctx} AS ctx FROM {name}0 {guard}),
{name} AS (SELECT x.narrative_id, x.ord, x.term AS reaction, x.start, lower({hit('ctx', lex.SEVERITY)}) AS severity, {strip(hit('ctx', lex.ONSET, 1))} AS onset,
    coalesce(lower({hit('ctx', lex.OUTCOME)}), 'unknown') AS outcome, d0.name AS drug
    FROM {name}1 x LEFT JOIN d0 ON d0.narrative_id = x.narrative_id AND d0.start <= x.start
    QUALIFY row_number() OVER (PARTITION BY x.narrative_id, x.ord ORDER BY d0.start DESC NULLS LAST, d0.ord) = 1)"""


FACTS = (
    f"SELECT narrative_id, {hit('mt', lex.AGE, 1)} AS age, lower({hit('mt', lex.SEX)}) AS sex, coalesce(lower({hit('mt', lex.CAUSALITY)}), 'unassessable') AS causality, "
    f"lower({hit('mt', lex.SEVERITY)}) AS overall_severity FROM n"
)
AWARE = (N, DL, RL, D0, drugs(60), reactions(True))
LOOSE = (N, DL, RL, D0, drugs(80), reactions(False))


def _redactions() -> tuple[str, ...]:
    out, at = [], "(SELECT narrative_id, mt AS t FROM n)"
    for i, (_, pattern, label) in enumerate(lex.REDACTIONS):
        out.append(f"x{i} AS (SELECT narrative_id, regexp_replace(t, {q(uni(pattern))}, {q(label)}, 'g') AS t FROM {at})")
        at = f"x{i}"
    return tuple(out)


def _findings() -> str:
    parts = []
    for i, (rule, pattern, label) in enumerate(lex.REDACTIONS):
        source = f"x{i - 1}" if i else "(SELECT narrative_id, mt AS t FROM n)"
        hits = f"regexp_extract_all(t, {q(uni(pattern))})"
        parts.append(
            f"SELECT narrative_id, {i} AS rule_no, {q(rule)} AS rule, {q(label)} AS label, unnest({hits}) AS original, "
            f"generate_subscripts({hits}, 1) AS k FROM (SELECT DISTINCT narrative_id, t FROM {source})"
        )
    both = "\nUNION ALL ".join(parts)
    return f"f AS (SELECT narrative_id, row_number() OVER (PARTITION BY narrative_id ORDER BY rule_no, k) - 1 AS hit_no, rule, {unmark('original')} AS original, label FROM ({both}))"


LAST = f"x{len(lex.REDACTIONS) - 1}"
TEXTS = [f for f, _ in lex.SECTIONS]


L = f"l AS (SELECT DISTINCT label_id, set_id, openfda, {', '.join(TEXTS)} FROM drug_labels)"
_heads = "|".join(re.escape(h) for h in lex.WARNING_HEADERS)
SECTIONS = f"""w0 AS (SELECT label_id, string_split_regex({strip('warnings[1]')}, {q(_heads)}) AS b, regexp_extract_all({strip('warnings[1]')}, {q(_heads)}) AS h FROM l WHERE warnings[1] IS NOT NULL),
w1 AS (SELECT label_id, unnest(range(2, len(b) + 1)) AS i, b, h FROM w0),
w2 AS (SELECT label_id, i - 1 AS pos, h[i - 1] AS header, {strip('b[i]')} AS body FROM w1),
w3 AS (SELECT * FROM w2 WHERE body <> '' AND NOT regexp_full_match(body, {q(f'(?i){_heads}')})),
ws AS (SELECT label_id, header, min(pos) AS ord, arg_max(body, pos) AS body FROM w3 GROUP BY ALL)"""
_cut = f"regexp_replace(regexp_replace({strip('adverse_reactions[1]')}, '([.!?]){WS}+([A-Z])', '\\1' || chr(31) || '\\2', 'g'), ';{WS}*', chr(31), 'g')"
_boiler = "|".join(re.escape(b) for b in lex.BOILERPLATE)
ITEMS = f"""i0 AS (SELECT label_id, string_split({_cut}, chr(31)) AS p FROM l WHERE adverse_reactions[1] IS NOT NULL),
i1 AS (SELECT label_id, unnest(range(1, len(p) + 1)) AS k, p FROM i0),
i2 AS (SELECT *, {mark('item')} AS mi FROM (SELECT label_id, k, rtrim({strip('p[k]')}, '.,;') AS item FROM i1)),
i3 AS (SELECT * FROM i2 WHERE length(item) >= 6 AND NOT regexp_matches(lower(item), {q(_boiler)}) AND NOT regexp_matches(mi, {q(uni(lex.PERCENT))})
    AND NOT regexp_matches(mi, {q(uni(lex.NUMBERS_ONLY))}) AND NOT regexp_matches(mi, {q('(?i)' + uni(lex.DOSE_ONLY))})
    AND NOT regexp_matches(mi, {q(rf'(?i)^(?:{lex.LEADING_WORDS})' + chr(92) + 'b')}) AND regexp_matches(item, {q(lex.FOUR_LETTERS)})),
it AS (SELECT label_id, row_number() OVER (PARTITION BY label_id ORDER BY k) - 1 AS pos, item FROM i3)"""


def _resolve(asked: str, steps: int) -> str:
    spelled = "array_to_string(list_filter(string_split_regex(lower({e}), '[^\\p{{L}}\\p{{N}}-]+'), lambda w: w <> ''), ' ')"
    whole = [("openfda.brand_name", 0), ("openfda.generic_name", 1), ("openfda.substance_name", 2)]
    if steps == 2:
        whole = whole[:2]
    parts = [
        f"SELECT a.name AS drug, {p} AS priority, e.label_id FROM a, (SELECT label_id, unnest({c}) AS e FROM l) e WHERE lower({strip('e.e')}) = a.name" for c, p in whole
    ]
    if steps > 2:
        names = [f"openfda.{f}" for f in ("brand_name", "generic_name", "substance_name", "manufacturer_name", "route", "product_type")]
        everything = "flatten([" + ", ".join(f"coalesce({c}, CAST([] AS VARCHAR[]))" for c in (*TEXTS, *names)) + "])"
        for c, p in (("openfda.generic_name", 3), ("openfda.substance_name", 4), (everything, 5)):
            parts.append(
                f"SELECT a.name, {p}, e.label_id FROM a, (SELECT label_id, ' ' || {spelled.format(e='e')} || ' ' AS e FROM (SELECT label_id, unnest({c}) AS e FROM l) WHERE e IS NOT NULL) e "
                f"WHERE a.own <> '' AND contains(e.e, ' ' || a.own || ' ')"
            )
    union = "\nUNION ALL ".join(parts)
    return (
        f"a AS (SELECT *, {spelled.format(e='name')} AS own FROM (SELECT DISTINCT lower({strip('drug')}) AS name FROM ({asked}) WHERE drug IS NOT NULL AND {strip('drug')} <> '')),\n"
        f"m AS (SELECT drug, label_id, CAST(priority AS BIGINT) AS priority FROM ({union}) QUALIFY row_number() OVER (PARTITION BY drug ORDER BY priority, label_id) = 1)"
    )


COUNTS = """c0 AS (SELECT DISTINCT report_id, line_no, upper(drug) AS drug, reaction AS term FROM reports WHERE drug IS NOT NULL AND reaction IS NOT NULL AND reaction <> ''),
c AS (SELECT *, row_number() OVER (PARTITION BY drug ORDER BY cnt DESC, term) AS rank FROM (SELECT drug, term, count(*) AS cnt FROM c0 GROUP BY ALL) QUALIFY rank <= 500),
ct AS (SELECT drug, lower(term) AS term, min(rank) AS rank, arg_max(cnt, rank) AS cnt FROM c GROUP BY ALL)"""
_skip = ", ".join(q(w.lower()) for w in (*lex.WARNING_HEADERS, *lex.EXCLUDED_TERMS))
_headers = ", ".join(q(w.lower()) for w in lex.WARNING_HEADERS)
PARTS = (
    "lp AS (SELECT DISTINCT label_id, coalesce(adverse_reactions[1], '') AS raw_reactions, coalesce(nullif(warnings[1], ''), nullif(warnings_and_precautions[1], ''), '') AS raw_warnings FROM l)"
)


def tag(term: str, blob: str, split: str) -> str:
    words = f"list_filter(string_split_regex({term}, '{split}'), lambda w: length(w) > 4)"
    return f"(contains(lower({blob}), {term}) OR (len({words}) > 0 AND len(list_filter({words}, lambda w: NOT contains(lower({blob}), w))) = 0))"


def all_in(words: str, term: str) -> str:
    return f"len(list_filter({words}, lambda w: NOT contains({term}, w))) = 0"




def _cases(*told: str) -> tuple[str, ...]:
    """Narratives with a drug, what its label holds, and their reactions, taken from the last part of ``told``, a table r or mr."""
    source = told[-1].split(" ", 1)[0] if told[-1].startswith("mr ") else "r"
    return (
        *told, L, SECTIONS, ITEMS, _resolve("SELECT drug_name AS drug FROM n", 6), PARTS,
        f"cs AS (SELECT n.narrative_id AS id, lower({strip('n.drug_name')}) AS drug_key, m.label_id, raw_reactions, raw_warnings FROM n LEFT JOIN m ON m.drug = lower({strip('n.drug_name')}) LEFT JOIN lp USING (label_id) WHERE n.drug_name IS NOT NULL)",
        f"ck AS (SELECT cs.*, x.* EXCLUDE (narrative_id) FROM cs JOIN {source} x ON x.narrative_id = cs.id)",
    )


CASES = _cases(*AWARE)
_any = "len(list_filter(list_filter(string_split_regex(lower(reaction), '" + WS.replace("{", "{{").replace("}", "}}") + "+'), lambda w: w <> ''), lambda w: contains(lower({b}), w))) > 0"
MATCHED = f"""mh AS (SELECT id, ord, string_agg(header, '|' ORDER BY s.ord2) AS headers FROM ck JOIN (SELECT label_id, header, body, ord AS ord2 FROM ws) s USING (label_id) WHERE {_any.format(b='body')} GROUP BY ALL),
mi AS (SELECT id, ord, count(*) AS items FROM ck JOIN it USING (label_id) WHERE {_any.format(b='item')} GROUP BY ALL),
mm AS (SELECT DISTINCT ck.id, CAST(ck.ord AS BIGINT) AS ord, reaction, headers IS NOT NULL OR items IS NOT NULL AS found_in_label, coalesce(headers, '') AS headers, coalesce(items, 0) AS items
    FROM ck LEFT JOIN mh USING (id, ord) LEFT JOIN mi USING (id, ord))"""
_kw = "list_filter(string_split_regex({t}, '" + WS.replace("{", "{{").replace("}", "}}") + "+'), lambda w: length(w) > 3)"


def _best(source: str, key: str, exact: str, like: str) -> str:
    """The first term of a drug that is equal, else the first that is like it, for rows with drug_key."""
    return f"""{source}_m AS (SELECT {key}, x.term, x.cnt FROM {source} s JOIN ct x ON lower(x.drug) = s.drug_key WHERE ({exact}) OR ({like})
    QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY ({exact}) DESC, x.rank) = 1)"""


_name = "CASE WHEN length(item) > 60 THEN CASE WHEN contains(substr(item, 1, 60), ' ') THEN regexp_extract(substr(item, 1, 60), '(?s)^(.*) [^ ]*$', 1) ELSE substr(item, 1, 60) END ELSE item END"
_tags = lambda t: f"list_filter([CASE WHEN {tag(f'lower(trim({t}))', 'coalesce(raw_reactions, chr(1))', NO_WORD)} THEN 'Adverse Reactions' END, CASE WHEN {tag(f'lower(trim({t}))', 'coalesce(raw_warnings, chr(1))', NO_WORD)} THEN 'Warning' END], lambda x: x IS NOT NULL)"
TOP = (
    COUNTS,
    # a drug's terms by rank of their folded form: the fifty first
    "t50 AS (SELECT *, row_number() OVER (PARTITION BY drug ORDER BY rank, term) AS k FROM ct QUALIFY k <= 50)",
)
REST = (
    *TOP,
    f"s1 AS (SELECT *, lower(trim(reaction)) AS key FROM ck WHERE lower(trim(reaction)) NOT IN ({_headers}))",
    _best("s1", "id, ord", "x.term = s.key", all_in(_kw.format(t="s.key"), "x.term")),
    f"s2 AS (SELECT id, drug_key, label_id, pos AS ord, {_name} AS reaction FROM cs JOIN it USING (label_id) WHERE lower(item) NOT IN ({_headers}))",
    _best("s2", "id, ord", "false", f"len({_kw.format(t='lower(s.reaction)')}) > 0 AND {all_in(_kw.format(t='lower(s.reaction)'), 'x.term')}"),
    f"s2w AS (SELECT DISTINCT id, s.ord FROM s2 s JOIN (SELECT label_id, body FROM ws) USING (label_id) WHERE len(list_filter({_kw.format(t='lower(s.reaction)')}, lambda w: contains(lower(body), w))) > 0)",
    "wo AS (SELECT label_id, body, row_number() OVER (PARTITION BY label_id ORDER BY ord) - 1 AS i FROM ws)",
    f"s3 AS (SELECT id, drug_key, i * (SELECT max(ord) + 1 FROM rl) + rl.ord AS ord, term AS reaction FROM cs JOIN wo USING (label_id) JOIN rl ON contains(lower(body), term) WHERE term NOT IN ({_skip}))",
    _best("s3", "id, ord", "x.term = s.reaction", "contains(x.term, s.reaction) OR contains(s.reaction, x.term)"),
    f"s4 AS (SELECT id, rank AS ord, term AS reaction, cnt, raw_reactions, raw_warnings FROM cs JOIN t50 ON lower(t50.drug) = cs.drug_key WHERE term NOT IN ({_skip}))",
    f"""u AS (SELECT s1.id, key, reaction, 1 AS src, s1.ord, severity, onset, outcome, true AS told, len({_tags('reaction')}) > 0 AS labelled, coalesce(cnt, 0) AS cnt, {_tags('reaction')} AS tags, drug
        FROM s1 LEFT JOIN s1_m ON s1_m.id = s1.id AND s1_m.ord = s1.ord
    UNION ALL SELECT s2.id, lower(trim(reaction)), reaction, 2, s2.ord, NULL, NULL, 'unknown', false, true, coalesce(cnt, 0),
        CASE WHEN s2w.id IS NULL THEN ['Adverse Reactions'] ELSE ['Adverse Reactions', 'Warning'] END, NULL
        FROM s2 LEFT JOIN s2_m ON s2_m.id = s2.id AND s2_m.ord = s2.ord LEFT JOIN s2w ON s2w.id = s2.id AND s2w.ord = s2.ord
    UNION ALL SELECT s3.id, reaction, reaction, 3, s3.ord, NULL, NULL, 'unknown', false, true, coalesce(cnt, 0), ['Warning'], NULL FROM s3 LEFT JOIN s3_m ON s3_m.id = s3.id AND s3_m.ord = s3.ord
    UNION ALL SELECT id, lower(trim(reaction)), reaction, 4, ord, NULL, NULL, 'unknown', false, len({_tags('reaction')}) > 0, cnt, {_tags('reaction')}, NULL FROM s4)""",
    """g AS (SELECT id, key, arg_min(reaction, (src, ord)) AS reaction, arg_max(severity, (src, ord)) FILTER (WHERE coalesce(severity, '') <> '') AS severity,
        arg_max(onset, (src, ord)) FILTER (WHERE coalesce(onset, '') <> '') AS onset, arg_max({'o': outcome}, (src, ord)) FILTER (WHERE outcome IS DISTINCT FROM 'unknown') AS oc,
        bool_or(told) AS in_narrative, bool_or(labelled) AS found_in_label, coalesce(arg_max(cnt, (src, ord)) FILTER (WHERE cnt <> 0), 0) AS report_count,
        arg_min(drug, (src, ord)) FILTER (WHERE coalesce(drug, '') <> '') AS drug, flatten(list(tags ORDER BY src, ord)) AS tags, min((src, ord)) AS o FROM u GROUP BY id, key)""",
    """f AS (SELECT id, reaction, severity, onset, CASE WHEN oc IS NULL THEN 'unknown' ELSE oc.o END AS outcome, in_narrative, found_in_label, CAST(report_count AS BIGINT) AS report_count, drug,
        CASE WHEN len(tags) = 0 THEN '' WHEN len(list_distinct(tags)) = 1 THEN tags[1] ELSE tags[1] || '|' || list_filter(tags, lambda x: x <> tags[1])[1] END AS label_sections,
        CAST(o[1] AS BIGINT) AS src, CAST(o[2] AS BIGINT) AS ord FROM g)""",
)
FULL = (*CASES, *REST)

OTHER = """o AS (SELECT DISTINCT ON (narrative_id) narrative_id AS id, extraction AS e, error FROM ai_extractions)"""
FX = f"fx AS ({FACTS})"
_points = (
    "(CASE WHEN {d} > 0 THEN 15 ELSE 0 END + CASE WHEN {dd} > 0 THEN 10 ELSE 0 END + CASE WHEN {r} > 0 THEN 15 ELSE 0 END + CASE WHEN {rs} > 0 THEN 8 ELSE 0 END + "
    "CASE WHEN {ro} > 0 THEN 4 ELSE 0 END + CASE WHEN {rt} > 0 THEN 3 ELSE 0 END + CASE WHEN coalesce({age}, '') <> '' THEN 10 ELSE 0 END + "
    "CASE WHEN coalesce({sex}, '') <> '' THEN 10 ELSE 0 END + CASE WHEN {caus} IS DISTINCT FROM 'unassessable' THEN 10 ELSE 0 END + CASE WHEN coalesce({sev}, '') <> '' THEN 10 ELSE 0 END)"
)


def _verdict(source: str) -> str:
    return f"SELECT narrative_id, CAST(points AS BIGINT) AS points, CASE WHEN points >= 80 THEN 'HIGH' WHEN points >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS verdict, points < 80 AS needs_ai FROM ({source})"


_n = lambda test, t: f"coalesce((SELECT count(*) FROM {t} z WHERE z.narrative_id = fx.narrative_id AND {test}), 0)"
POINTS = "SELECT fx.narrative_id, " + _points.format(
    d=_n("true", "d"), dd=_n("coalesce(dose, '') <> ''", "d"), r=_n("true", "r"), rs=_n("coalesce(severity, '') <> ''", "r"), ro=_n("coalesce(onset, '') <> ''", "r"),
    rt=_n("outcome IS DISTINCT FROM 'unknown'", "r"), age="age", sex="sex", caus="causality", sev="overall_severity",
) + " AS points FROM fx"
_l = lambda f, test: f"coalesce(len(list_filter(e.{f}, lambda x: {test})), 0)"
POINTS_OTHER = "SELECT id AS narrative_id, " + _points.format(
    d="coalesce(len(e.drugs), 0)", dd=_l("drugs", "coalesce(x.dose, '') <> ''"), r="coalesce(len(e.reactions), 0)", rs=_l("reactions", "coalesce(x.severity, '') <> ''"),
    ro=_l("reactions", "coalesce(x.onset, '') <> ''"), rt=_l("reactions", "x.outcome IS DISTINCT FROM 'unknown'"), age="e.patient.age", sex="e.patient.sex",
    caus="e.causality", sev="e.overall_severity",
) + " AS points FROM o WHERE id IN (SELECT narrative_id FROM n)"
BOTH = (
    *LOOSE, FX, OTHER,
    "od AS (SELECT id, lower(x.name) AS name, i FROM (SELECT id, unnest(e.drugs) AS x, generate_subscripts(e.drugs, 1) AS i FROM o))",
    'ox AS (SELECT id, x.reaction AS reaction, x.severity AS severity, x.onset AS onset, x.outcome AS outcome, x.drug AS drug, i FROM (SELECT id, unnest(e.reactions) AS x, generate_subscripts(e.reactions, 1) AS i FROM o))',
    "p AS (SELECT fx.*, o.e, o.error FROM fx JOIN o ON o.id = fx.narrative_id)",
    """sd AS (SELECT narrative_id AS id,
        (SELECT list_sort(list(DISTINCT name)) FROM od WHERE od.id = p.narrative_id AND name IS NOT NULL AND name NOT IN (SELECT d.name FROM d WHERE d.narrative_id = p.narrative_id)) AS do1,
        (SELECT list_sort(list(DISTINCT d.name)) FROM d WHERE d.narrative_id = p.narrative_id AND d.name NOT IN (SELECT name FROM od WHERE od.id = p.narrative_id AND name IS NOT NULL)) AS dr,
        (SELECT list_sort(list(DISTINCT lower(reaction))) FROM ox WHERE ox.id = p.narrative_id AND reaction IS NOT NULL AND lower(reaction) NOT IN (SELECT r.reaction FROM r WHERE r.narrative_id = p.narrative_id)) AS ro,
        (SELECT list_sort(list(DISTINCT r.reaction)) FROM r WHERE r.narrative_id = p.narrative_id AND r.reaction NOT IN (SELECT lower(reaction) FROM ox WHERE ox.id = p.narrative_id AND reaction IS NOT NULL)) AS rr FROM p)""",
)
_join = lambda c: f"coalesce(array_to_string({c}, '|'), '')"


def _gap(field: str, mine: str, theirs: str) -> str:
    return f"SELECT narrative_id AS id, '{field}' AS field, {mine} AS rules_value, {theirs} AS other_value FROM p WHERE {mine} IS DISTINCT FROM {theirs}"


FIELD_GAPS = " UNION ALL ".join(_gap(f, f, f"e.{f}") for f in ("causality", "overall_severity"))
PATIENT_GAPS = " UNION ALL ".join((_gap("age", "age", "e.patient.age"), _gap("sex", "sex", "e.patient.sex"), _gap("relevant_history", "CAST(NULL AS VARCHAR)", "e.patient.relevant_history")))
DETAIL = " UNION ALL ".join(
    f"SELECT ox.id, ox.reaction, ox.i, r.ord, '{f}' AS field, r.{f} AS rules_value, ox.{f} AS other_value FROM ox JOIN r ON r.narrative_id = ox.id AND r.reaction = lower(ox.reaction) "
    f"WHERE (r.{f} IS NULL OR r.{f} = 'unknown') AND NOT (ox.{f} IS NULL OR ox.{f} = 'unknown')"
    for f in ("severity", "onset", "outcome")
)
_fine = "(o.id IS NOT NULL AND o.error IS NULL)"
COMPARED = _cases(*BOTH, f"""mr AS (SELECT narrative_id, row_number() OVER (PARTITION BY narrative_id ORDER BY src, k) - 1 AS ord, reaction, severity, onset, outcome, drug FROM (
    SELECT narrative_id, 0 AS src, ord AS k, reaction, severity, onset, outcome, drug FROM r
    UNION ALL SELECT ox.id, 1, ox.i, ox.reaction, ox.severity, ox.onset, ox.outcome, ox.drug FROM ox JOIN o ON o.id = ox.id
        WHERE {_fine} AND ox.reaction IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r WHERE r.narrative_id = ox.id AND r.reaction = lower(ox.reaction))))""")
NER = f"""e0 AS (SELECT narrative_id, t, instr(lower(t), w) AS place, w AS word, kind FROM n, (SELECT name AS w, 'Drug' AS kind FROM dl UNION SELECT term, 'Disease' FROM rl) WHERE contains(lower(t), w)),
e1 AS (SELECT *, row_number() OVER (PARTITION BY narrative_id ORDER BY place, word, kind) - 1 AS seq FROM e0),
e2 AS (SELECT x.narrative_id, x.word AS reaction, {mark('substr(x.t, greatest(x.place - 1 - 30, 0) + 1, x.place - 1 + length(x.word) + 80 - greatest(x.place - 1 - 30, 0))')} AS ctx, y.word AS drug
    FROM e1 x LEFT JOIN e1 y ON y.narrative_id = x.narrative_id AND y.kind = 'Drug' AND y.seq < x.seq AND y.place <= x.place WHERE x.kind = 'Disease'
    QUALIFY row_number() OVER (PARTITION BY x.narrative_id, x.seq ORDER BY y.place DESC NULLS LAST, y.seq) = 1)"""

SQL = {
    "deid_redact": with_(N, *_redactions()) + f"SELECT DISTINCT n.narrative_id, {unmark('z.t')} AS redacted, {unmark('z.t')} <> n.t AS changed FROM n JOIN {LAST} z USING (narrative_id)",
    "deid_findings": with_(N, *_redactions(), _findings()) + "SELECT narrative_id, hit_no, rule, original, label FROM f",
    "deid_rule_counts": with_(N, *_redactions(), _findings()) + "SELECT rule, count(*) AS hits, count(DISTINCT narrative_id) AS narratives FROM f GROUP BY rule",
    "redaction_marked": with_(N, *_redactions()) + f"SELECT DISTINCT narrative_id, regexp_replace({unmark('t')}, '(\\[[A-Z]+\\])', '<mark>\\1</mark>', 'g') AS marked FROM {LAST}",
    "collapse_ws": f"SELECT * FROM (SELECT doc_id, regexp_replace({strip('text')}, '{WS}+', ' ', 'g') AS text FROM documents) WHERE length(text) > 20",
    "drug_mentions": with_(N, DL, D0, drugs(80)) + "SELECT narrative_id, CAST(ord AS BIGINT) AS ord, name, start, dose, route, indication FROM d",
    "drug_doses_aware": with_(N, DL, D0, drugs(60)) + "SELECT DISTINCT narrative_id, name, dose FROM d",
    "reactions_substring": with_(*LOOSE) + "SELECT narrative_id, CAST(ord AS BIGINT) AS ord, start, reaction, severity, onset, outcome, drug FROM r",
    "reactions_aware": with_(*AWARE) + "SELECT narrative_id, CAST(ord AS BIGINT) AS ord, start, reaction, severity, onset, outcome, drug FROM r",
    "reactions_by_drug": with_(*AWARE) + "SELECT coalesce(drug, '<none>') AS drug, count(*) AS reactions, count(DISTINCT narrative_id) AS narratives FROM r GROUP BY 1",
    "patient_facts": with_(N) + FACTS,
    "extraction_notes": with_(*LOOSE) + """SELECT narrative_id, a AS drugs, b AS reactions, 'Extracted by rules. ' || a || ' drug(s), ' || b || ' reaction(s) found.' AS notes FROM (
        SELECT narrative_id, (SELECT count(*) FROM d WHERE d.narrative_id = n.narrative_id) AS a, (SELECT count(*) FROM r WHERE r.narrative_id = n.narrative_id) AS b FROM n)""",
    "distinct_drugs": with_(N, DL, D0) + "SELECT narrative_id, name, CAST(min(ord) AS BIGINT) AS first_ord FROM d0 GROUP BY ALL",
    "drug_headers": with_(*LOOSE) + "SELECT DISTINCT r.narrative_id, r.drug, dose, route FROM r JOIN d ON d.narrative_id = r.narrative_id AND d.name = r.drug",
    "evidence_sentence": with_(*LOOSE, "s0 AS (SELECT narrative_id, regexp_extract_all(t, '[^.!?]+[.!?]*') AS s FROM n)")
    + f"SELECT DISTINCT r.narrative_id, reaction, coalesce(regexp_replace({strip('list_filter(s, lambda x: contains(lower(x), reaction))[1]')}, '(?i)(' || regexp_escape(reaction) || ')', '<mark>\\1</mark>', 'g'), '') AS sentence FROM r JOIN s0 USING (narrative_id)",
    "report_counts_top": with_(COUNTS) + "SELECT drug, term, cnt, rank FROM c",
    "report_top50": with_(*TOP) + f"SELECT drug, term, k AS rank, cnt FROM t50 WHERE term NOT IN ({_skip})",
    "report_map": """SELECT concat_ws('|', feed, drug) AS drug, lower(term) AS term, CAST(min(rank_no) AS BIGINT) AS rank, coalesce(arg_max_null(cnt, rank_no), 0) AS cnt
        FROM (SELECT DISTINCT feed, drug, term, cnt, rank_no FROM report_counts WHERE term IS NOT NULL) GROUP BY 1, 2""",
    "label_resolve": with_(L, _resolve("SELECT drug_name AS drug FROM narratives", 6)) + "SELECT * FROM m",
    "label_resolve_two_steps": with_(L, _resolve("SELECT drug_name AS drug FROM narratives", 2)) + "SELECT * FROM m",
    "label_warning_sections": with_(L, SECTIONS) + "SELECT label_id, CAST(ord AS BIGINT) AS ord, header, body FROM ws",
    "label_ar_items": with_(L, ITEMS) + "SELECT label_id, pos, item FROM it",
    "label_side_effects": with_(L, SECTIONS, ITEMS)
    + "SELECT label_id, 'Adverse Reactions' AS section, pos AS ord, CAST(NULL AS VARCHAR) AS label, item AS text FROM it UNION ALL SELECT label_id, 'Warnings', ord, header, body FROM ws",
    "label_projection": with_(L) + "SELECT label_id, "
    + ", ".join(f"CASE WHEN openfda.{c} IS NULL THEN 'N/A' ELSE coalesce(array_to_string(list_transform(openfda.{c}, lambda x: coalesce(x, '-')), '|'), '') END AS {c}" for c in ("brand_name", "generic_name", "manufacturer_name", "route", "product_type"))
    + ", coalesce(adverse_reactions[1], '') AS adverse_reactions_raw, coalesce(nullif(warnings[1], ''), nullif(warnings_and_precautions[1], ''), '') AS warnings_raw, "
    + ", ".join(f"{c}[1] AS {c}" for c in ("boxed_warning", "contraindications", "drug_interactions", "indications_and_usage", "dosage_and_administration")) + " FROM l",
    "label_sections": with_(L) + "SELECT label_id, CAST(i AS BIGINT) AS ord, section, text FROM (" + " UNION ALL ".join(
        f"SELECT label_id, {i} AS i, {q(t)} AS section, regexp_replace({strip(f + '[1]')}, '{WS}+', ' ', 'g') AS text FROM l" for i, (f, t) in enumerate(lex.SECTIONS)) + ") WHERE length(text) > 20",
    "label_titles": with_(L) + """SELECT DISTINCT label_id, CASE WHEN openfda.generic_name[1] <> '' THEN coalesce(openfda.brand_name[1], 'the drug') || ' (' || openfda.generic_name[1] || ')'
        ELSE coalesce(openfda.brand_name[1], 'the drug') END AS title, CASE WHEN set_id <> '' THEN 'https://labels.example.org/drugInfo.cfm?setid=' || set_id ELSE 'https://labels.example.org/search.cfm?query=the drug' END AS link FROM l""",
    "keyword_context": with_(L, "k AS (SELECT label_id, regexp_extract_all(lower(concat_ws(' ', array_to_string(adverse_reactions, ' '), array_to_string(warnings, ' '), array_to_string(warnings_and_precautions, ' '))), '.{50}dose.{50}') AS h FROM l)")
    + "SELECT label_id, i - 1 AS hit_no, h[i] AS context FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM k)",
    "report_match": with_(*AWARE, COUNTS, f"s AS (SELECT n.narrative_id, lower({strip('drug_name')}) AS drug_key, ord, reaction FROM n JOIN r USING (narrative_id) WHERE drug_name IS NOT NULL)",
        _best("s", "narrative_id, ord", "x.term = s.reaction", all_in(f"list_filter(string_split_regex(replace(s.reaction, '-', ' '), '{WS}+'), lambda w: length(w) > 3)", "x.term")))
    + "SELECT s.narrative_id, upper(drug_key) AS drug_key, CAST(s.ord AS BIGINT) AS ord, reaction, m.term AS matched_term, coalesce(m.cnt, 0) AS report_count FROM s LEFT JOIN s_m m ON m.narrative_id = s.narrative_id AND m.ord = s.ord",
    "label_match": with_(*CASES, MATCHED) + "SELECT id, ord, reaction, found_in_label, headers, items FROM mm",
    "label_gaps": with_(*CASES, MATCHED) + "SELECT id, ord, reaction FROM mm WHERE NOT found_in_label",
    "label_tags": with_(*CASES) + f"SELECT DISTINCT id, CAST(ord AS BIGINT) AS ord, reaction, coalesce(array_to_string({_tags('reaction')}, '|'), '') AS tags FROM ck",
    "full_comparison": with_(*FULL) + "SELECT * FROM f",
    "novel_reactions": with_(*FULL) + "SELECT id, reaction, report_count FROM f WHERE NOT found_in_label",
    "confidence": with_(*AWARE, FX) + _verdict(POINTS),
    "confidence_other_engine": with_(N, OTHER) + _verdict(POINTS_OTHER),
    "engine_setdiff": with_(*BOTH) + f"SELECT id, {_join('do1')} AS drugs_only_other, {_join('dr')} AS drugs_only_rules, {_join('ro')} AS reactions_only_other, {_join('rr')} AS reactions_only_rules FROM sd",
    "engine_detail_gaps": with_(*BOTH) + f"SELECT id, reaction, field, rules_value, other_value FROM ({DETAIL})",
    "engine_field_gaps": with_(*BOTH) + FIELD_GAPS,
    "engine_patient_gaps": with_(*BOTH) + PATIENT_GAPS,
    "engine_diff_summary": with_(*BOTH, f"gp AS (SELECT id, count(*) AS k FROM ({FIELD_GAPS} UNION ALL {PATIENT_GAPS}) GROUP BY id)", f"gd AS (SELECT id, count(*) AS k FROM (SELECT DISTINCT id, i, ord FROM ({DETAIL})) GROUP BY id)")
    + "SELECT sd.id, coalesce(len(do1), 0) AS drugs_missed, coalesce(len(ro), 0) AS reactions_missed, coalesce(gp.k, 0) + coalesce(gd.k, 0) AS total_gaps FROM sd LEFT JOIN gp ON gp.id = sd.id LEFT JOIN gd ON gd.id = sd.id",
    "engine_merge": with_(*BOTH, f"""ar AS (SELECT narrative_id AS id, reaction FROM r UNION ALL SELECT ox.id, lower(ox.reaction) FROM ox JOIN o ON o.id = ox.id WHERE {_fine} AND ox.reaction IS NOT NULL
            AND lower(ox.reaction) NOT IN (SELECT r.reaction FROM r WHERE r.narrative_id = ox.id))""",
        f"ad AS (SELECT narrative_id AS id, name FROM d UNION ALL SELECT od.id, od.name FROM od JOIN o ON o.id = od.id WHERE {_fine} AND od.name IS NOT NULL AND od.name NOT IN (SELECT d.name FROM d WHERE d.narrative_id = od.id))")
    + f"""SELECT fx.narrative_id AS id, (SELECT count(*) FROM ad WHERE ad.id = fx.narrative_id) AS drugs, (SELECT count(*) FROM ar WHERE ar.id = fx.narrative_id) AS reactions,
        coalesce((SELECT string_agg(reaction, '|' ORDER BY reaction) FROM ar WHERE ar.id = fx.narrative_id), '') AS names,
        CASE WHEN {_fine} AND fx.causality = 'unassessable' THEN coalesce(o.e.causality, fx.causality) ELSE fx.causality END AS causality,
        CASE WHEN {_fine} AND fx.overall_severity IS NULL THEN o.e.overall_severity ELSE fx.overall_severity END AS overall_severity,
        CASE WHEN {_fine} THEN o.e.patient.relevant_history END AS relevant_history FROM fx LEFT JOIN o ON o.id = fx.narrative_id""",
    "ner_extract": with_(N, DL, RL, NER) + f"SELECT narrative_id, reaction, lower({hit('ctx', lex.SEVERITY)}) AS severity, {strip(hit('ctx', lex.ONSET, 1))} AS onset, 'unknown' AS outcome, drug FROM e2",
    "request_errors": f"SELECT DISTINCT narrative_id, CAST(400 AS BIGINT) AS code, 'No narrative provided' AS message FROM narratives WHERE regexp_full_match(coalesce(narrative, ''), '{WS}*')",
    "json_sink": f"SELECT DISTINCT narrative_id, coalesce({strip('drug_name')}, '') AS drug_name, coalesce({strip('narrative')}, '') AS narrative, coalesce(engine, 'openai') AS engine FROM narratives",
    "engine_routes": f"""SELECT DISTINCT narrative_id, CASE WHEN engine = 'huggingface' THEN 'entities' ELSE 'extractions' END AS provider, 'not available' AS error
        FROM narratives WHERE NOT regexp_full_match(coalesce(narrative, ''), '{WS}*')""",
    "engines_full_comparison": with_(*COMPARED, *REST) + "SELECT * FROM f",
    "engines_novel_reactions": with_(*COMPARED, *REST) + "SELECT id, reaction, report_count FROM f WHERE NOT found_in_label",
    "engines_label_match": with_(*COMPARED, MATCHED) + "SELECT id, ord, reaction, found_in_label, headers, items FROM mm",
    "engines_label_gaps": with_(*COMPARED, MATCHED) + "SELECT id, ord, reaction FROM mm WHERE NOT found_in_label",
    "extraction_documents": with_(N, DL, RL, D0, FX, drugs(60, "da"), reactions(True, "ra"), drugs(80, "db"), reactions(False, "rb"),
        "la AS (SELECT narrative_id, list({'name': name, 'dose': dose} ORDER BY ord) AS x FROM da GROUP BY 1)",
        "lb AS (SELECT narrative_id, list({'name': name, 'dose': dose, 'route': route, 'indication': indication} ORDER BY ord) AS x FROM db GROUP BY 1)",
        *(f"l{k} AS (SELECT narrative_id, list({{'reaction': reaction, 'severity': severity, 'onset': onset, 'outcome': outcome, 'drug': drug}} ORDER BY ord) AS x FROM {k} GROUP BY 1)" for k in ("ra", "rb")))
    + """SELECT DISTINCT fx.narrative_id, 'aware' AS engine, CAST(to_json({'drugs': coalesce(la.x, []), 'reactions': coalesce(lra.x, []), 'patient': {'age': age, 'sex': sex}, 'causality': causality,
            'overall_severity': overall_severity}) AS VARCHAR) AS document FROM fx LEFT JOIN la USING (narrative_id) LEFT JOIN lra USING (narrative_id)
        UNION ALL SELECT DISTINCT fx.narrative_id, 'substring', CAST(to_json({'drugs': coalesce(lb.x, []), 'reactions': coalesce(lrb.x, []), 'patient': {'age': age, 'sex': sex, 'relevant_history': CAST(NULL AS VARCHAR)},
            'causality': causality, 'overall_severity': overall_severity,
            'notes': 'Extracted by rules. ' || coalesce(len(lb.x), 0) || ' drug(s), ' || coalesce(len(lrb.x), 0) || ' reaction(s) found.'}) AS VARCHAR)
        FROM fx LEFT JOIN lb USING (narrative_id) LEFT JOIN lrb USING (narrative_id)""",
    "analysis_documents": with_(*FULL, MATCHED, FX, f"sc AS ({_verdict(POINTS)})",
        "fr AS (SELECT id, count(*) AS k, list_sort(list(reaction) FILTER (WHERE NOT found_in_label)) AS novel FROM f GROUP BY id)",
        "fg AS (SELECT id, list_sort(list(reaction)) AS gaps FROM mm WHERE NOT found_in_label GROUP BY id)")
    + """SELECT DISTINCT cs.id, CAST(to_json({'points': points, 'verdict': verdict, 'rows': coalesce(k, 0), 'novel_reactions': coalesce(novel, []), 'label_gaps': coalesce(gaps, [])}) AS VARCHAR) AS document
        FROM cs JOIN sc ON sc.narrative_id = cs.id LEFT JOIN fr ON fr.id = cs.id LEFT JOIN fg ON fg.id = cs.id""",
    "keyword_found": with_(L, "b AS (SELECT label_id, lower(concat_ws(' ', array_to_string(adverse_reactions, ' '), array_to_string(warnings, ' '), array_to_string(warnings_and_precautions, ' '))) AS t FROM l)")
    + "SELECT DISTINCT label_id, k AS keyword, contains(t, k) AS found FROM b, (SELECT unnest(['nausea and vomiting', 'vomiting', 'dose']) AS k)",
    "drug_labels_asked": with_(L, SECTIONS, ITEMS, _resolve("SELECT drug_name AS drug FROM narratives", 6),
        "hs AS (SELECT label_id, count(*) AS k FROM ws GROUP BY 1)", "hi AS (SELECT label_id, count(*) AS k FROM it GROUP BY 1)")
    + "SELECT a.name AS drug, l.label_id, "
    + ", ".join(f"CASE WHEN l.label_id IS NULL THEN NULL WHEN openfda.{c} IS NULL THEN 'N/A' ELSE coalesce(array_to_string(list_transform(openfda.{c}, lambda x: coalesce(x, '-')), '|'), '') END AS {c}" for c in ("brand_name", "generic_name", "manufacturer_name", "route", "product_type"))
    + ", CASE WHEN l.label_id IS NOT NULL THEN coalesce(adverse_reactions[1], '') END AS adverse_reactions_raw, CASE WHEN l.label_id IS NOT NULL THEN coalesce(nullif(warnings[1], ''), nullif(warnings_and_precautions[1], ''), '') END AS warnings_raw, "
    "CASE WHEN l.label_id IS NOT NULL THEN coalesce(hs.k, 0) END AS sections, CASE WHEN l.label_id IS NOT NULL THEN coalesce(hi.k, 0) END AS items, "
    "CASE WHEN l.label_id IS NULL THEN 'No label found for ' || chr(39) || a.name || chr(39) END AS error FROM a LEFT JOIN m ON m.drug = a.name LEFT JOIN l USING (label_id) LEFT JOIN hs USING (label_id) LEFT JOIN hi USING (label_id)",
    "drug_sections_asked": with_(L, _resolve("SELECT drug_name AS drug FROM narratives", 6)) + "SELECT m.drug, label_id, CAST(i AS BIGINT) AS ord, section, text, "
    """CASE WHEN openfda.generic_name[1] <> '' THEN coalesce(openfda.brand_name[1], m.drug) || ' (' || openfda.generic_name[1] || ')' ELSE coalesce(openfda.brand_name[1], m.drug) END AS title,
        CASE WHEN set_id <> '' THEN 'https://labels.example.org/drugInfo.cfm?setid=' || set_id ELSE 'https://labels.example.org/search.cfm?query=' || m.drug END AS link FROM m JOIN (""" + " UNION ALL ".join(
        f"SELECT label_id, openfda, set_id, {i} AS i, {q(t)} AS section, regexp_replace({strip(f + '[1]')}, '{WS}+', ' ', 'g') AS text FROM l" for i, (f, t) in enumerate(lex.SECTIONS)) + ") USING (label_id) WHERE length(text) > 20",
}

_check = f"""ld AS (SELECT r.*, lp.label_id IS NOT NULL AND ({tag('reaction', 'raw_reactions', WS + '+')} OR {tag('reaction', 'raw_warnings', WS + '+')}) AS found FROM r LEFT JOIN m ON m.drug = lower(r.drug) LEFT JOIN lp USING (label_id))"""
_per_drug = (*LOOSE, L, _resolve("SELECT drug FROM r", 6), PARTS, _check)
SQL["label_check_per_drug"] = with_(*_per_drug) + "SELECT narrative_id, CAST(ord AS BIGINT) AS ord, reaction, drug, found FROM ld"
SQL["in_label_counts"] = with_(*_per_drug) + "SELECT coalesce(drug, '<none>') AS drug, CAST(count_if(found) AS BIGINT) AS in_label, CAST(count_if(NOT found) AS BIGINT) AS not_in_label FROM ld GROUP BY 1"
SQL["summary_cards"] = with_(*_per_drug, "lc AS (SELECT narrative_id, count_if(found) AS a, count_if(NOT found) AS b FROM ld GROUP BY 1)") + """SELECT DISTINCT n.narrative_id, (SELECT count(*) FROM d WHERE d.narrative_id = n.narrative_id) AS drugs,
    (SELECT count(*) FROM r WHERE r.narrative_id = n.narrative_id) AS reactions, CAST(coalesce(lc.a, 0) AS BIGINT) AS in_label, CAST(coalesce(lc.b, 0) AS BIGINT) AS not_in_label FROM n LEFT JOIN lc USING (narrative_id)"""
