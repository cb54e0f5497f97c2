"""Column functions on bibliographic records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that don't make a key.
STOP = (
    "a an the of in on for and to from with by at is are was were be been its their this that these those or as do does did has have had not no but "
    "can could will would may might shall should how what which who where when why using towards toward between through into about over under after "
    "before during within"
).split()
# Kinds of records, and entry types; every other kind is an article.
TYPES = {"article": "article", "article in press": "article", "review": "article", "conference paper": "inproceedings", "book chapter": "incollection", "book": "book", "editorial": "article", "letter": "article", "note": "article", "short survey": "article", "erratum": "article", "data paper": "article"}
# A record is relevant if one of these occurs in its title, abstract or keywords.
TERMS = [
    "deforestation", "forest loss", "forest cover change", "forest degradation", "land use change", "lulc", "land cover", "land use",
    "post-conflict", "peacebuilding", "armed conflict", "peace agreement", "ecosystem services", "carbon stock", "biodiversity", "carbon storage",
    "remote sensing", "gee", "google earth engine", "landsat", "sentinel", "ca-markov", "cellular automata", "land change model", "markov chain",
    "gwr", "geographically weighted", "spatial regression", "hotspot analysis", "getis-ord", "spatial statistics", "moran",
    "colombia", "tropical deforestation", "amazon", "magdalena", "olofsson", "accuracy assessment", "area estimation",
    "hansen", "global forest change", "invest", "habitat quality", "water yield", "random forest", "machine learning classification",
]
# Kinds that are left out unless cited more often than this.
EXCLUDED, CITED = ("review", "conference paper"), 20
# BibTeX fields, and the columns of an export that give them.
COLUMNS = {"authors": ("authors", "author full names"), "title": ("title",), "year": ("year",), "journal": ("source title",), "volume": ("volume",), "issue": ("issue",), "start": ("page start",), "end": ("page end",), "number": ("art. no.",), "doi": ("doi",), "keywords": ("author keywords",), "kind": ("document type",), "cited": ("cited by",)}


def strip_accents(s: Column) -> Column:
    """Compatibility decomposition without combining marks. Spark has no Unicode normal forms, so batches go to Python."""

    @F.pandas_udf("string")
    def plain(x):  # no hints: pandas is imported on the workers only
        import unicodedata

        return x.map(lambda t: t if t is None or t.isascii() else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))

    return plain(s)


def first_of(*cols: Column) -> Column:
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in cols), F.lit(""))


def cited_by(s: Column) -> Column:
    return F.coalesce(F.trim(s).try_cast("int"), F.lit(0))


def authors(s: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.split(F.coalesce(s, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != ""), " and ")


def _capitalised(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 30)))


def first_author(s: Column, plain=strip_accents) -> Column:
    """Last name of the first author: no marks, its parts (by blanks and hyphens) capitalised and joined, letters only."""
    name = plain(F.trim(F.split(F.split(F.coalesce(s, F.lit("")), ";")[0], ",")[0]))
    key = F.regexp_replace(F.array_join(F.transform(F.split(name, r"[\s\-]+"), _capitalised), ""), "[^A-Za-z]", "")
    return F.when(key == "", F.lit("Unknown")).otherwise(key)


def title_word(s: Column, stop: Sequence[str] = STOP, plain=strip_accents) -> Column:
    """The first word that isn't a stop word, capitalised; else the first word; else Untitled."""
    words = F.regexp_extract_all(plain(F.coalesce(s, F.lit(""))), F.lit("([A-Za-z]+)"))
    good = F.filter(words, lambda w: ~F.lower(w).isin(*stop))
    return _capitalised(F.coalesce(F.try_element_at(good, F.lit(1)), F.try_element_at(words, F.lit(1)), F.lit("Untitled")))


def citation_key(author: Column, year: Column, title: Column, plain=strip_accents) -> Column:
    return F.concat(first_author(author, plain), F.coalesce(F.nullif(F.trim(year.cast("string")), F.lit("")), F.lit("XXXX")), title_word(title, plain=plain))


def escaped(s: Column) -> Column:
    return F.regexp_replace(s, r"(?<!\\)&", r"\\&")


def record_type(s: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in TYPES.items() for x in kv)), F.lower(F.trim(s))), F.lit("article"))


def pages(start: Column, end: Column, number: Column) -> Column:
    a, b = first_of(start), first_of(end)
    return F.when((a != "") & (b != "") & (a != b), F.concat(a, F.lit("--"), b)).when(a != "", a).otherwise(first_of(number))


def relevant(terms: Sequence[str], *texts: Column) -> Column:
    """Whether any term occurs, whatever the case: one alternation of quoted terms. Letters change case one by one, so that a dotted capital I is an i."""
    text = F.lower(F.replace(F.concat_ws(" ", *texts), F.lit("\u0130"), F.lit("i")))
    return text.rlike("|".join("\\Q" + t.lower() + "\\E" for t in terms))


def excluded(kind: Column, cited: Column) -> Column:
    """Reviews and conference papers, unless cited more than CITED times."""
    return F.coalesce(F.lower(F.trim(kind)), F.lit("")).isin(*EXCLUDED) & (cited_by(cited) <= CITED)


def record_fields(columns: Mapping[str, str] | Sequence[str]) -> dict[str, Column]:
    """The fields of COLUMNS from an export's columns; missing ones are empty."""
    return {k: first_of(*(F.col(f"`{c}`") for c in names if c in columns)) if any(c in columns for c in names) else F.lit("") for k, names in COLUMNS.items()}


def rendered(record: Mapping[str, Column], key: Column) -> Column:
    """A BibTeX entry of the fields that aren't empty; a conference paper's journal is its book title."""
    kind = record_type(record["kind"])
    who = authors(record["authors"])
    at = pages(record["start"], record["end"], record["number"])
    fields = [
        ("author", escaped(who), who), ("title", F.concat(F.lit("{"), escaped(record["title"]), F.lit("}")), record["title"]),
        ("booktitle", escaped(record["journal"]), F.when(kind == "inproceedings", record["journal"])), ("journal", escaped(record["journal"]), F.when(kind != "inproceedings", record["journal"])),
        ("year", record["year"], record["year"]), ("volume", record["volume"], record["volume"]), ("number", record["issue"], record["issue"]),
        ("pages", at, at), ("doi", record["doi"], record["doi"]), ("keywords", escaped(record["keywords"]), record["keywords"]),
    ]
    lines = F.filter(F.array(*(F.when(there != "", F.concat(F.lit(f"  {name:<12}= {{"), value, F.lit("},"))) for name, value, there in fields)), lambda x: x.isNotNull())
    return F.concat_ws("\n", F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",")), lines, F.lit("}"))
