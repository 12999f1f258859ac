"""Pages and movies as the services return them: JSON columns parsed by schema, nothing in Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import strip

# fixed values: how many of a cast count, up to which place one leads, and headings of the section that tells the story
CAST_LIMIT, LEADS = 15, 5
PLOT_HEADINGS = ["plot", "plot summary", "synopsis", "story", "storyline", "കഥ", "കഥാസംഗ്രഹം", "கதை", "కథ", "कथानक", "कथा", "ಕಥಾವಸ್ತು", "কাহিনি", "কাহিনী"]
_HEADING = r"(?m)^==[^\S\n]*([^=\n].*?)[^\S\n]*==[^\S\n]*$"
_MOVIE = (
    "id long, imdb_id string, original_title string, original_language string, release_date string, alternative_titles struct<titles: array<struct<title: string, iso_3166_1: string>>>, "
    "translations struct<translations: array<struct<iso_639_1: string, data: struct<title: string>>>>, credits struct<cast: array<struct<id: long, name: string, `order`: int>>, crew: array<struct<id: long, name: string, job: string>>>"
)
_PAGE = "query struct<pages: array<struct<missing: boolean, title: string, extract: string, revisions: array<struct<revid: long>>, canonicalurl: string, fullurl: string>>>"


def year_of(date: Column) -> Column:
    """The first four characters of a date of at least so many."""
    return F.when(F.length(date) >= 4, F.substring(date, 1, 4).cast("int"))


def parse_movie(payload: Column) -> Column:
    """struct(tmdb_id, imdb_id, original_title, original_language, release_year, titles, credits) of a movie's JSON.

    titles (title, language, region, kind): the original one, other ones that aren't empty, translations. credits (person_id,
    name, role_kind, billing_order): the first CAST_LIMIT of the cast, leads up to the fifth place, then directors."""
    # the parsed movie is the one element of an array, whose function reads it by name: it is parsed once, however often it is read
    return F.get(F.transform(F.array(F.from_json(payload, _MOVIE)), _movie), 0)


def _movie(m: Column) -> Column:
    none = F.lit(None).cast("string")
    title = lambda t, language, region, kind: F.struct(t.alias("title"), language.alias("language"), region.alias("region"), F.lit(kind).alias("kind"))
    filled = lambda rows, of: F.filter(F.coalesce(rows, F.array().cast(rows_type[of])), lambda x: F.coalesce((x["title"] if of == "alt" else x["data"]["title"]) != "", F.lit(False)))
    rows_type = {"alt": "array<struct<title: string, iso_3166_1: string>>", "tr": "array<struct<iso_639_1: string, data: struct<title: string>>>"}
    titles = F.concat(
        F.array(title(m["original_title"], m["original_language"], none, "canonical")),
        F.transform(filled(m["alternative_titles"]["titles"], "alt"), lambda x: title(x["title"], none, x["iso_3166_1"], "aka")),
        F.transform(filled(m["translations"]["translations"], "tr"), lambda x: title(x["data"]["title"], x["iso_639_1"], none, "translation")),
    )
    credit = lambda x, role, order: F.struct(x["id"].alias("person_id"), x["name"].alias("name"), role.alias("role_kind"), order.alias("billing_order"))
    cast = F.transform(F.slice(F.coalesce(m["credits"]["cast"], F.array().cast("array<struct<id: long, name: string, `order`: int>>")), 1, CAST_LIMIT), lambda x: credit(x, F.when(F.coalesce(x["order"], F.lit(99)) < LEADS, "lead").otherwise("support"), x["order"]))
    crew = F.filter(F.coalesce(m["credits"]["crew"], F.array().cast("array<struct<id: long, name: string, job: string>>")), lambda x: x["job"] == "Director")
    directors = F.transform(crew, lambda x: credit(x, F.lit("director"), F.lit(None).cast("int")))
    return F.struct(m["id"].alias("tmdb_id"), m["imdb_id"].alias("imdb_id"), m["original_title"].alias("original_title"), m["original_language"].alias("original_language"), year_of(m["release_date"]).alias("release_year"), titles.alias("titles"), F.concat(cast, directors).alias("credits"))


def parse_page(payload: Column) -> Column:
    """struct(title, extract, revision_id, url) of a page's JSON; null if the page is missing or has no extract or revision."""
    p = F.get(F.from_json(payload, _PAGE)["query"]["pages"], 0)
    there = ~F.coalesce(p["missing"], F.lit(False)) & p["extract"].isNotNull() & (F.size(p["revisions"]) > 0)
    url = F.coalesce(F.nullif(p["canonicalurl"], F.lit("")), p["fullurl"], F.lit(""))
    return F.when(there, F.struct(p["title"].alias("title"), p["extract"].alias("extract"), F.get(p["revisions"], 0)["revid"].cast("string").alias("revision_id"), url.alias("url")))


def lead_and_plot(extract: Column) -> Column:
    """struct(lead, plot): what stands before the first heading of the second level, and the section under the first heading
    that names a plot, null if there is none or it is empty."""
    headings = F.regexp_extract_all(extract, F.lit(_HEADING), F.lit(1))
    parts = F.split(extract, _HEADING)
    named = F.filter(F.transform(headings, lambda h, i: F.struct(F.lower(h).isin(PLOT_HEADINGS).alias("is_plot"), (i + 1).alias("at"))), lambda x: x["is_plot"])
    return F.struct(strip(F.get(parts, 0)).alias("lead"), F.nullif(strip(F.get(parts, F.get(named, 0)["at"])), F.lit("")).alias("plot"))


def text_to_store(extract: Column) -> Column:
    """Lead, empty line and plot where there is a plot, else the whole."""
    parts = lead_and_plot(extract)
    return F.when(parts["plot"].isNotNull(), strip(F.concat(parts["lead"], F.lit("\n\n"), parts["plot"]))).otherwise(strip(extract))
