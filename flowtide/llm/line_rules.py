"""Line-first cleaning: rules on lines, then a verdict on what is left of the text."""

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, doc_and, packed, python_tasks, table, texts_of

#: A line may end a sentence with these.
ENDS = ".!?…:;\"'”’»)"
#: Phrases of menus, banners and footers.
BOILERPLATE = (
    "accept all cookies",
    "all comments",
    "back to top",
    "click here",
    "cookie policy",
    "enable javascript",
    "javascript is disabled",
    "log in",
    "lorem ipsum",
    "powered by",
    "privacy policy",
    "read more",
    "share on",
    "sign in",
    "sign up",
    "skip to content",
    "subscribe to our newsletter",
    "terms of service",
    "terms of use",
    "use cookies",
)
#: A line of at most so many words is boilerplate if it holds such a phrase.
BOILERPLATE_WORDS = 20
#: A line without an end needs so many words and some punctuation to pass.
OPEN_WORDS = 8
#: Symbols or exclamation marks: more than 3 for 10 words fail a line.
NOISE = 3
#: More than this percentage of the words lost rejects the document.
MOST_LOST = 40
LEAST_WORDS, MOST_REPEATED = 50, 50

_SPACE, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
_ENDS = tuple(c.encode() for c in ENDS)
_MARKS = re.compile(rb"[.!?,;:]")
_PHRASES = re.compile("|".join(map(re.escape, BOILERPLATE)).encode())
_BARS = re.compile(b"|".join(re.escape(c.encode()) for c in "|»›•"))


def failure(line: bytes, n: int) -> str | None:
    """The rule that a line of ``n`` words fails, if any."""
    bars = len(_BARS.findall(line))
    if bars >= 2 and 4 * bars >= n:
        return "navigation"
    if n <= BOILERPLATE_WORDS and _PHRASES.search(line.lower()):
        return "boilerplate"
    symbols = len(line) - len(line.translate(None, _SYMBOLS))
    if 10 * symbols > NOISE * n or n >= 5 and 10 * line.count(b"!") > NOISE * n:
        return "punctuation"
    if not line.rstrip(_SPACE).endswith(_ENDS) and (n < OPEN_WORDS or not _MARKS.search(line)):
        return "punctuation"
    return None


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that the text holds twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == n:
        return 0
    covered, upto = 0, 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


#: What is known of a text, in order.
FACTS = [
    ("n_words", pa.int64()),
    ("word_chars", pa.int64()),
    ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()),
    ("n_lines", pa.int64()),
    ("n_navigation", pa.int64()),
    ("n_boilerplate", pa.int64()),
    ("n_punctuation", pa.int64()),
    ("n_lost_words", pa.int64()),
    ("base_failed", pa.bool_()),
    ("kept", pa.bool_()),
    ("clean_text", pa.string()),
]


def examine(text: bytes, with_text: bool = True) -> tuple:
    """The :data:`FACTS` of a text."""
    words = text.split()
    n_words = len(words)
    seen: set[bytes] = set()
    failed = Counter()
    lines = dup = lost = 0
    good = []
    for line in text.split(b"\n"):
        n = len(line.split())
        if n:
            lines += 1
            dup += line in seen
            seen.add(line)
            if rule := failure(line, n):
                failed[rule] += 1
                lost += n
                continue
        if with_text:
            good.append(line)
    repeated = repeated_words(words)
    characters = len(text.decode("utf-8", "replace")) - (len(text) - len(text.translate(None, _SPACE)))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    base_failed = n_words < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n_words
    kept = not base_failed and 100 * lost <= MOST_LOST * n_words
    clean = b"\n".join(good).decode("utf-8", "replace") if with_text else None
    rules = (failed["navigation"], failed["boilerplate"], failed["punctuation"])
    return (n_words, characters, symbols, dup, repeated, lines, *rules, lost, base_failed, kept, clean)


def _examined(batches: Iterable[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        facts = [examine(text or b"", with_text) for text in texts_of(batch.column("text"))]
        arrays = [pa.array(c, kind) for c, (_, kind) in zip(zip(*facts), FACTS)]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), *arrays], names=["doc", *(name for name, _ in FACTS)])


def clean_lines(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """One row a document: the struct ``doc`` with its columns, and :data:`FACTS`.

    Lines end at ``\\n``; those without a word are neither judged nor counted. A
    line fails as navigation (two bars or more, one for four words), as boilerplate
    (a known phrase in a short line) or for its punctuation (symbols, exclamation
    marks, or no end of a sentence). ``clean_text`` are the other lines. A document
    fails at once with under 50 words or more than half of its words in repeated
    3-word windows, and is rejected if its failed lines hold over 40 % of its words.
    Null and empty texts have no words and fail.
    """
    python_tasks(docs.sparkSession)
    rows = packed(docs).drop("rid")
    names = {pa.int64(): "long", pa.bool_(): "boolean", pa.string(): "string"}
    out = doc_and(rows, ", ".join(f"{name} {names[t]}" for name, t in FACTS))
    return rows.mapInArrow(lambda it: _examined(it, with_text), out)


def op4_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return facts.select("doc.doc_id", *(name for name, _ in FACTS if name != "clean_text"))


def op4_sql() -> str:
    word = r"'[^\x20\x09-\x0D]+'"
    phrases = "|".join(BOILERPLATE)
    ends = "".join(ENDS).replace("'", "''")
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), {word}) AS w
  FROM documents
), lines AS (
  SELECT rid, line, len(regexp_extract_all(line, {word})) AS n
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs)
), judged AS (
  SELECT rid, line, n, CASE
    WHEN bars >= 2 AND 4 * bars >= n THEN 'navigation'
    WHEN n <= {BOILERPLATE_WORDS} AND regexp_matches(line, '{phrases}', 'i') THEN 'boilerplate'
    WHEN 10 * length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) > {NOISE} * n
      OR (n >= 5 AND 10 * length(regexp_replace(line, '[^!]', '', 'g')) > {NOISE} * n) THEN 'punctuation'
    WHEN NOT regexp_matches(line, '[{ends}][\x20\x09-\x0D]*$') AND (n < {OPEN_WORDS} OR NOT regexp_matches(line, '[.!?,;:]'))
      THEN 'punctuation' END AS rule
  FROM (SELECT *, length(regexp_replace(line, '[^|»›•]', '', 'g')) AS bars FROM lines WHERE n > 0)
), by_line AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
    count(*) FILTER (rule = 'navigation') AS n_navigation, count(*) FILTER (rule = 'boilerplate') AS n_boilerplate,
    count(*) FILTER (rule = 'punctuation') AS n_punctuation, coalesce(sum(n) FILTER (rule IS NOT NULL), 0)::BIGINT AS n_lost_words
  FROM judged GROUP BY rid
), windows AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS times
  FROM (
    SELECT rid, unnest(range(1, len(w) - 1)) AS i, unnest(w[1:len(w) - 2]) AS a, unnest(w[2:len(w) - 1]) AS b, unnest(w[3:]) AS c
    FROM docs WHERE len(w) > 2
  )
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words
  FROM windows, (VALUES (0), (1), (2)) AS steps(k) WHERE times > 1 GROUP BY rid
), facts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_navigation, 0) AS n_navigation,
    coalesce(n_boilerplate, 0) AS n_boilerplate, coalesce(n_punctuation, 0) AS n_punctuation,
    coalesce(n_lost_words, 0) AS n_lost_words
  FROM docs LEFT JOIN by_line USING (rid) LEFT JOIN covered USING (rid)
), failed AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM facts
)
SELECT *, NOT base_failed AND 100 * n_lost_words <= {MOST_LOST} * n_words AS kept FROM failed
"""
