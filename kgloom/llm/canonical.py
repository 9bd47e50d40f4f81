"""Problem 4: mapping free-entered values to a canonical list. SQL only.

A value is brought to its core: marks, blanks, brackets and quotes cut, packed alternatives parted,
kind words (those that stand in a share of the list's own entries: Castle, Theorem, 镇, 定理) and their abbreviations,
articles and place qualifiers dropped. Cores of the list are cut into K+1 segments; a value within K edits must
hold one of them nearly in place, so an equality join on (length, segment number, substring) finds
every candidate, and Spark's ``levenshtein`` verifies it. Values without an entry come out through an
anti-join. Only distinct cores are compared.
"""
from __future__ import annotations

from pyspark.sql import DataFrame

# share of the list's entries in which a word or ending is a kind (Castle, 镇), and in which an ending is the longest such one
WORD_SHARE, ENDING_SHARE = 0.015, 0.0125
K = 2  # edits allowed in a core of at least 8 letters; shorter cores allow one edit or one swap of neighbours

CLEAN = r"""
regexp_replace(regexp_replace(regexp_replace(regexp_replace({v},
  '[\\u200b-\\u200f\\u2060\\ufeff\\u00ad]', ''),
  '\\(\\?\\)|（\\?）|[(（](?:旧称|待核|存疑)[)）]', ' '),
  '[“”"「」『』?？。！!;；*＊†#~]|^[\'‘]|[\'’]$', ' '),
  '(?U)[_\\s]+', ' ')
"""
PLAIN = "translate(lower({v}), 'àâäáãåçèéêëìíîïñóòôöõúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"

STEPS = {
    # kind words and kind endings: words of the list's own names that stand in many of them, by share of the list and in three entries at least
    "entries": "SELECT count(DISTINCT ref_id) AS n FROM ref_entries",
    "kind_words": f"""
        SELECT w FROM (SELECT DISTINCT ref_id, explode(split(lower(name_en), ' ')) AS w FROM ref_entries) WHERE w <> ''
        GROUP BY w HAVING count(*) >= (SELECT greatest(3, {WORD_SHARE} * n) FROM entries)""",
    "endings": "SELECT DISTINCT ref_id, right(name, n) AS e, n FROM (SELECT ref_id, name, explode(sequence(1, 4)) AS n FROM ref_entries WHERE name IS NOT NULL) WHERE length(name) > n + 1",
    # an ending counts where it is the longest frequent one of the name, so a letter that merely closes longer endings is none
    "frequent_endings": f"SELECT e FROM endings GROUP BY e HAVING count(*) >= (SELECT greatest(3, {WORD_SHARE} * n) FROM entries)",
    "kind_endings": f"""
        SELECT e FROM (SELECT a.ref_id, max_by(a.e, a.n) AS e FROM endings a JOIN frequent_endings f ON a.e = f.e GROUP BY a.ref_id)
        GROUP BY e HAVING count(*) >= (SELECT greatest(3, {ENDING_SHARE} * n) FROM entries)""",
    # one row; a share of the list bounds both arrays to some hundreds, whatever its length
    "kinds": "SELECT coalesce((SELECT collect_list(w) FROM kind_words), array()) AS words, coalesce((SELECT collect_list(e) FROM kind_endings), array()) AS endings",
    "vals": """
        SELECT 'kb_name' AS field, CAST(mention_id AS STRING) AS row_id, 0 AS pos, kb_name AS v FROM linked_mentions
        WHERE disambiguation_method = 'manual_entry' AND kb_name IS NOT NULL AND regexp_replace(kb_name, '(?U)\\\\s', '') <> ''
        UNION SELECT 'mention', CAST(mention_id AS STRING), 0, mention FROM linked_mentions
        WHERE disambiguation_method = 'manual_entry' AND (kb_name IS NULL OR regexp_replace(kb_name, '(?U)\\\\s', '') = '')
        UNION SELECT 'aliases', entity_id, pos, v FROM (SELECT entity_id, posexplode(aliases) AS (pos, v) FROM kb WHERE name IS NULL)""",
    "parts": "SELECT v, trim(p) AS p FROM (SELECT v, explode(split({clean}, ' ?[/|｜] ?')) AS p FROM (SELECT DISTINCT v FROM vals WHERE v IS NOT NULL)) WHERE trim(p) <> ''",
    "entry_parts": "SELECT ref_id, trim(p) AS p FROM (SELECT ref_id, explode(array(name, name_en)) AS p FROM ref_entries) WHERE trim(p) <> ''",
}
# core of a part: the longest word that is no kind word for Latin writing, the rest before the longest kind ending for ideographs
CORES = """
    SELECT {key}, p, han, kind, core FROM (
      SELECT {key}, p, han, CASE WHEN han THEN ending ELSE array_join(array_sort(filter(toks, t -> array_contains(words, t))), ' ') END AS kind,
        CASE WHEN han THEN substring(bare, 1, length(bare) - length(ending))
             ELSE {plain} END AS core
      FROM (
        SELECT {key}, p, han, bare, words, toks, coalesce(array_max(transform(filter(endings, e -> length(bare) > length(e) + 1 AND endswith(bare, e)), e -> struct(length(e) AS n, e AS e))).e, '') AS ending
        FROM (
          SELECT {key}, p, p RLIKE '[\\\\x{{4e00}}-\\\\x{{9fff}}]' AS han, words, endings,
            regexp_replace(regexp_replace(regexp_replace(p, '^[^·•・]{{1,3}}[·•・]', ''), '[ ,，、.·]', ''), '^(?:旧|原|老)(?=.{{4,}})', '') AS bare,
            split(trim(regexp_replace(lower(regexp_replace(p, '([\\\\p{{Ll}}])([\\\\p{{Lu}}])', '$1 $2')), '[ ,]+', ' ')), ' ') AS toks
          FROM {src} CROSS JOIN kinds)))
    WHERE length(core) >= 2"""
LATIN_CORE = PLAIN.format(v="coalesce(array_max(transform(filter(toks, t -> NOT array_contains(words, t) AND t NOT IN ('the', 'of') AND NOT endswith(t, '.')), t -> struct(length(t) AS n, t AS t))).t, '')")


def _sql(spark, name: str, q: str, **args) -> None:
    spark.sql(q, args=args or None).createOrReplaceTempView(name)


def map_values(mentions: DataFrame, kb: DataFrame, refs: DataFrame, k: int = K) -> DataFrame:
    """(field, row_id, pos, v, ref_id, edits): one row per value asked for; ref_id 0 and null edits where no entry is meant.

    Null and blank values are unmatched. Repeated rows count once. Where two entries are equally near, one whose kind
    word agrees goes first, then the smaller ref_id; an entry of another kind is not meant when its kind is named.
    """
    spark = mentions.sparkSession
    mentions.select("mention_id", "mention", "kb_name", "disambiguation_method").createOrReplaceTempView("linked_mentions")
    kb.select("entity_id", "name", "aliases").createOrReplaceTempView("kb")
    refs.select("ref_id", "name", "name_en").createOrReplaceTempView("ref_entries")
    for name, q in STEPS.items():
        _sql(spark, name, q.replace("{clean}", CLEAN.format(v="v")) if name == "parts" else q)
    _sql(spark, "value_cores", CORES.format(key="v", src="parts", plain=LATIN_CORE))
    _sql(spark, "entry_cores", CORES.format(key="ref_id", src="entry_parts", plain=LATIN_CORE))
    # segments of the list: K+1 of nearly equal length
    _sql(spark, "segments", f"""
        SELECT DISTINCT ref_id, han, kind, core, length(core) AS len, i, 1 + (i * length(core)) DIV {k + 1} AS at, substring(core, 1 + (i * length(core)) DIV {k + 1}, ((i + 1) * length(core)) DIV {k + 1} - (i * length(core)) DIV {k + 1}) AS seg
        FROM (SELECT *, explode(sequence(0, {k})) AS i FROM entry_cores) WHERE ((i + 1) * length(core)) DIV {k + 1} > (i * length(core)) DIV {k + 1}""")
    # substrings of the values: for each length the entry may have, each segment and each shift of at most K
    _sql(spark, "probes", f"""
        SELECT DISTINCT han, core, len, i, substring(core, at, n) AS seg FROM (
          SELECT han, core, len, i, (i * len) DIV {k + 1} + 1 + s AS at, ((i + 1) * len) DIV {k + 1} - (i * len) DIV {k + 1} AS n FROM (
            SELECT han, core, len, i, explode(sequence(-{k}, {k})) AS s FROM (
              SELECT han, core, len, explode(sequence(0, {k})) AS i FROM (
                SELECT han, core, explode(sequence(greatest(2, length(core) - {k}), length(core) + {k})) AS len FROM (SELECT DISTINCT han, core FROM value_cores)))))
        WHERE at >= 1 AND n >= 1 AND at + n - 1 <= length(core)""")
    _sql(spark, "near", f"""
        SELECT han, core, ref_id, kind, min(edits) AS edits FROM (
          SELECT p.han, p.core, s.ref_id, s.kind, levenshtein(p.core, s.core, {k}) AS edits, s.core AS entry,
                 array_sort(split(p.core, '')) = array_sort(split(s.core, '')) AS swapped
          FROM probes p JOIN segments s ON p.han = s.han AND p.len = s.len AND p.i = s.i AND p.seg = s.seg)
        WHERE edits >= 0 AND (edits <= 1 OR swapped OR length(entry) >= 8) GROUP BY han, core, ref_id, kind""")
    _sql(spark, "best", """
        SELECT v, min_by(ref_id, rank) AS ref_id, min(edits) AS edits FROM (
          SELECT c.v, n.ref_id, n.edits, struct(n.edits AS e, CASE WHEN c.kind = n.kind THEN 0 ELSE 1 END AS k, n.ref_id AS r) AS rank
          FROM value_cores c JOIN near n ON c.han = n.han AND c.core = n.core WHERE c.kind = '' OR n.kind = '' OR c.kind = n.kind OR (NOT c.han AND contains(n.kind, c.kind)))
        GROUP BY v""")
    return spark.sql("SELECT a.field, a.row_id, a.pos, a.v, coalesce(b.ref_id, 0) AS ref_id, b.edits FROM vals a LEFT JOIN best b ON a.v = b.v")


def unmatched(mentions: DataFrame, kb: DataFrame, refs: DataFrame) -> DataFrame:
    """Values that mean no entry, with how often they stand (anti-join)."""
    map_values(mentions, kb, refs)
    return mentions.sparkSession.sql("SELECT a.field, a.v AS value, count(*) AS n FROM vals a LEFT ANTI JOIN best b ON a.v = b.v GROUP BY a.field, a.v")
