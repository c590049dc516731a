"""Virtual books: the standard tables with planted structure, the same in Spark and in SQL.

A book holds the documents of one source in a range of 1000 ids, so it stays of
book size whatever the tables' size and however a source prevails.  Every
expression below is SQL that both engines read alike; ``{nl}`` is a line end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NL = {"spark": "'\\n'", "duck": "chr(10)"}

#: Documents set apart by blank lines, some after a heading, a speaker's name, a centred line or a run of headings.
_PIECE = """case when doc_id % 5 = 0 then concat('Chapter ', cast(cast(floor(doc_id / 5) as bigint) % 40 + 1 as {str}), {nl}, {nl})
  when doc_id % 7 = 0 then concat('HAMLET', {nl}, {nl})
  when doc_id % 11 = 0 then concat('        CENTRED WORDS ', cast(doc_id as {str}), {nl}, {nl})
  when doc_id % 13 = 0 then concat('The First Day', {nl}, {nl}, 'The Second Day', {nl}, {nl}, 'The Third Day', {nl}, {nl})
  when doc_id % 17 = 0 then concat('The Sea and the Sky', {nl}, {nl}, 'Part II', {nl}, {nl}) else '' end"""
STRUCTURED = f"concat({_PIECE}, replace(coalesce(text, ''), {{nl}}, concat({{nl}}, {{nl}})))"

#: Documents as blocks of lines, indented by two blanks, a tab or nothing, some with hyphens at line ends.
_HYPHENS = "case when doc_id % 4 = 0 then replace(coalesce(text, ''), concat('.', {nl}), concat('-', {nl})) else coalesce(text, '') end"
_MARGIN = "case doc_id % 3 when 0 then '  ' when 1 then chr(9) else '' end"
INDENTED = f"concat({_MARGIN}, replace({_HYPHENS}, {{nl}}, concat({{nl}}, {_MARGIN})))"

#: Boilerplate marks around the text, or in the wrong half of it.
MARKED = """case doc_id % 4
  when 0 then concat('A header', {nl}, '*** START OF THE PROJECT GUTENBERG EBOOK X ***', {nl}, coalesce(text, ''), {nl}, 'End of the Project Gutenberg EBook of X', {nl}, 'licence')
  when 1 then concat(coalesce(text, ''), {nl}, '*** START OF THIS PROJECT GUTENBERG EBOOK X ***', {nl}, 'tail')
  when 2 then concat('*END*THE SMALL PRINT! for X', {nl}, {nl}, coalesce(text, ''), {nl}, {nl}, '*** END OF THIS PROJECT GUTENBERG EBOOK X ***', {nl})
  else coalesce(text, '') end"""

#: Line ends of three kinds, bells, lines of blanks, and runs of dashes.
_ROUGH = "concat(replace(replace(coalesce(text, ''), ', ', ' -- '), {nl}, concat({nl}, '  ', chr(9), {nl}, '---')), chr(7))"
ROUGH = f"case doc_id % 3 when 0 then replace({_ROUGH}, {{nl}}, concat(chr(13), chr(13), {{nl}})) when 1 then replace({_ROUGH}, {{nl}}, concat(chr(13), {{nl}})) else replace({_ROUGH}, {{nl}}, chr(13)) end"
ROUGH_LINES = _ROUGH

#: Illustrations on one line and on several, with and without a chapter's line.
ILLUSTRATED = "concat('[Illustration: a ship]', coalesce(text, ''), {nl}, '[Illustration:', {nl}, '  Chapter ', cast(doc_id as {str}), '.]', {nl}, 'x [Illustration]', {nl}, coalesce(text, ''))"

#: Headers with an author in several forms.
_NAME = "concat(upper(substring(coalesce(source, 'x'), 1, 1)), substring(coalesce(source, 'x'), 2), ' Writer')"
AUTHORED = f"""concat(case doc_id % 6
  when 0 then concat('A Tale', {{nl}}, {{nl}}, 'by ', {_NAME}, {{nl}})
  when 1 then concat('A Tale', {{nl}}, 'BY', {{nl}}, {{nl}}, {_NAME}, {{nl}})
  when 2 then concat('by one two three four five six seven', {{nl}}, 'By  Good Name', {{nl}})
  when 3 then concat('Robert A. Heinlein. Starship Troopers', {{nl}})
  when 4 then concat('Mary Shelley. Frankenstein', {{nl}}, 'by', {{nl}}, 'ab', {{nl}})
  else '' end, coalesce(text, ''))"""

#: Paragraph ends and blank lines of several lengths.
SPACED = "replace(coalesce(text, ''), {nl}, case doc_id % 4 when 0 then {nl} when 1 then concat({nl}, {nl}) when 2 then concat({nl}, {nl}, {nl}) else concat({nl}, ' & <i>\"quoted\"</i> it''s', {nl}, {nl}, {nl}, {nl}, {nl}) end)"

BOOK = "concat(coalesce(source, 'none'), '-', cast(cast(floor(doc_id / 1000) as bigint) as {str}))"

#: Every fifth document twenty times, every tenth with chapters before, every fifteenth on one line.
LONG = "case when doc_id % 15 = 0 then repeat(replace(coalesce(text, ''), {nl}, ' '), 20) when doc_id % 5 = 0 then concat(case when doc_id % 10 = 0 then concat('Chapter 1', {nl}, {nl}, 'a', {nl}, {nl}, 'Chapter 2', {nl}, {nl}) else '' end, repeat(concat(coalesce(text, ''), {nl}), 20)) else coalesce(text, '') end"

#: A line for each heading rule, for and against.
LINES = [
    "Chapter 1", "CHAPTER XIV. The Storm", "chapter one", "Part II", "Book 3: Rome", "Prologue", "Epilogue - After", "Prefaces", "1. The Start", "12. lower case", "iv. The Fourth of Them",
    "Act II", "Scene 3", "1 - The Slow Fuse", "XIV", "XIV.", "XIVA", "I am", "To be", "\"Quoted Title Here\"", "‘Single Quoted’", "[Bracketed Words]", "(Round Words)", "Is This It?", "Stop That Now!", "Some Words;", "Other Words:",
    "THE   GAP", "The Road 12", "Enter Hamlet", "Re-enter Ghost", "Exeunt All", "CORNELIUS. Your Highness", "S. VERNON.", "THE LONG AND WINDING ROAD.", "THE CALL", "SUNNYVALE, CALIFORNIA", "Smith: Yes Sir", "As I Ponder'd in Silence",
    "One's-Self I Sing", "A lower word Here", "1 The Frozen Years", "The Sentence Ends Here.", "The, Comma Title", "Single", "One Two Three Four Five Six Seven Eight", "One Two Three Four Five Six Seven Eight Nine", "", "Été Français", "O'er the Hill",
]


def sql(expression: str, engine: str) -> str:
    return expression.replace("{nl}", NL[engine]).replace("{str}", {"spark": "string", "duck": "varchar"}[engine])


def documents(spark: SparkSession, sf_dir: str, expression: str) -> DataFrame:
    """(doc_id, source, text): every document's text under an expression of this module."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "source", f"{sql(expression, 'spark')} AS text")


def books(spark: SparkSession, sf_dir: str, expression: str, sep: str = "\n\n") -> DataFrame:
    """(book_id, text): every document's text under an expression, joined by book in order of ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", f"{sql(BOOK, 'spark')} AS book_id", f"{sql(expression, 'spark')} AS t")
    joined = "listagg(t, '{}') WITHIN GROUP (ORDER BY doc_id)".format(sep.replace("\n", "\\n"))
    return docs.selectExpr("book_id", "doc_id", "t").groupBy("book_id").agg(_expr(joined).alias("text"))


def _expr(s: str):
    from pyspark.sql import functions as F

    return F.expr(s)


def documents_sql(expression: str) -> str:
    """The common table expression ``src`` (doc_id, source, text) of ``documents``."""
    return f"src AS (SELECT doc_id, source, {sql(expression, 'duck')} AS text FROM documents)"


def books_sql(expression: str, sep: str = "\n\n") -> str:
    """The common table expression ``books`` (book_id, text) of ``books``."""
    s = " || ".join(["chr(10)"] * len(sep))
    return f"books AS (SELECT book_id, string_agg(t, {s} ORDER BY doc_id) AS text FROM (SELECT doc_id, {sql(BOOK, 'duck')} AS book_id, {sql(expression, 'duck')} AS t FROM documents) GROUP BY book_id)"


def lines(books_: DataFrame) -> DataFrame:
    """(book_id, pos, line)."""
    return books_.selectExpr("book_id", "posexplode(split(text, '\\n')) AS (pos, line)")
