"""Column expressions for module documents: counts, items, answers, groups, limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragmenta.functions.blocks import plain_similarities
from fragmenta.functions.text import FAKE_CANDID, any_of, collapse, is_debris, positive_int, present, strip, title_case
from fragmenta.session import ship

# Fixed values.
ITEM_TYPES = {"pilihan_ganda": "multiple_choice", "isian": "short_answer", "uraian": "essay", "essay": "essay", "short_answer": "short_answer", "multiple_choice": "multiple_choice"}
NOT_RELEVANT = ("KURANG", "KURANG_RELEVAN", "TIDAK_RELEVAN", "TIDAKRELEVAN")
SECTION_DEPENDENTS = {
    "tp": ("kktp", "materi", "aktivitas", "asesmen", "rubrik", "glosarium"),
    "kktp": ("asesmen", "rubrik"),
    "topic": ("glosarium",),
    "material": ("aktivitas", "asesmen", "glosarium"),
    "materi": ("aktivitas", "asesmen", "glosarium"),
    "aktivitas": ("asesmen", "rubrik"),
    "asesmen": ("rubrik",),
    "diagnostik": ("rubrik",),
    "formatif": ("rubrik",),
    "sumatif": ("rubrik",),
}
BANNED_TERM = r"(?i)\b(peserta\s+didik|siswa)\b"
INFORMAL_TERM = r"(?i)\b(dan\s+lain(?:-lain|nya| sebagainya)|dll|dsb|dst|etc)\b"
GENERIC_TITLES = ("untitled", "tanpa judul", "document", "microsoft word", "pdf", "hasil pemindaian")
LETTERHEAD = "(?i)kementerian|direktorat|dinas|pemerintah|republik|universitas|sekolah|madrasah"
NO_TITLE = r"(?i)^(kata pengantar|daftar isi|daftar pustaka|bab\s+\w+|bagian\s+\w+|oleh|penulis|disusun oleh|karya|penerbit|diterbitkan oleh)\b"


def lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def item_type(raw: Column) -> Column:
    """The canonical type of an assessment item; what is unknown is a short answer."""
    return F.coalesce(lookup(ITEM_TYPES, F.replace(F.lower(collapse(raw)), F.lit(" "), F.lit("_"))), F.lit("short_answer"))


def assessment_count(raw: Column, default: int) -> Column:
    """A count of 0 to 30: the default where none is given, null where it isn't valid."""
    return F.when(~present(raw.cast("string")), F.lit(default).cast("bigint")).otherwise(positive_int(raw, 0, 30))


def meeting_spec(meetings: Column, periods: Column, minutes_per_period: Column) -> Column:
    """struct(meetings, minutes_each, total, error): both counts or neither must be given."""
    given = present(meetings.cast("string")) | present(periods.cast("string"))
    n, jp = positive_int(meetings), positive_int(periods)
    error = F.when(given & (n.isNull() | jp.isNull()), "BAD_COUNTS").when(given & minutes_per_period.isNull(), "NO_MINUTES")
    good = given & error.isNull()
    return F.struct(F.when(good, n).alias("meetings"), F.when(good, jp * minutes_per_period).alias("minutes_each"), F.when(good, n * jp * minutes_per_period).alias("total"), error.alias("error"))


def period_minutes(requests: DataFrame, table: DataFrame) -> DataFrame:
    """requests (institution, phase, grade) with minutes: by grade if the table has it, else by phase; null: no rule."""
    by_grade = table.where("grade is not null").select("institution", "phase", "grade", F.col("minutes").alias("__g"))
    by_phase = table.where("grade is null").select("institution", "phase", F.col("minutes").alias("__p"))
    met = requests.join(by_grade, ["institution", "phase", "grade"], "left").join(by_phase, ["institution", "phase"], "left")
    return met.withColumn("minutes", F.coalesce("__g", "__p")).drop("__g", "__p")


def mc_item(question: Column, options: Column, answer: Column) -> Column:
    """struct(options, answer, error): texts (array) labelled A, B, ..; the answer as a label."""
    labelled = F.transform(options, lambda o, i: F.struct(F.char(i + 65).alias("label"), strip(o).alias("text")))
    a = strip(answer)
    by_label = F.when((F.length(a) == 1) & F.exists(labelled, lambda o: o["label"] == F.upper(a)), F.upper(a))
    by_text = F.try_element_at(F.filter(labelled, lambda o: F.lower(o["text"]) == F.lower(a)), F.lit(1))["label"]
    key = F.coalesce(by_label, by_text)
    error = F.when(~present(strip(question)), "NO_QUESTION").when(F.coalesce(F.size(options) < 4, F.lit(True)), "TOO_FEW_OPTIONS").when(F.exists(labelled, lambda o: ~present(o["text"])), "EMPTY_OPTION").when(key.isNull(), "NO_SUCH_ANSWER")
    return F.struct(labelled.alias("options"), F.when(error.isNull(), key).alias("answer"), error.alias("error"))


def relevance(response: Column) -> Column:
    """struct(items, warn) of an answer in JSON; unknown ratings go, the first of an element counts; null if none is left."""
    kind = "relevansi array<struct<elemen:string,nilai:string,alasan:string>>, saran string, perlu_warning boolean"
    r = F.from_json(response, kind)
    rating = lambda x: F.regexp_replace(F.upper(strip(F.coalesce(x["nilai"], F.lit("")))), "[ -]", "_")
    named = F.transform(F.coalesce(r["relevansi"], F.array().cast("array<struct<elemen:string,nilai:string,alasan:string>>")), lambda x: F.struct(strip(x["elemen"]).alias("element"), F.when(rating(x).isin(*NOT_RELEVANT), "KURANG_RELEVAN").when(rating(x) == "RELEVAN", "RELEVAN").alias("rating"), strip(F.coalesce(x["alasan"], F.lit(""))).alias("reason")))
    good = F.filter(named, lambda x: present(x["element"]) & x["rating"].isNotNull())
    first = F.filter(good, lambda x, i: ~F.exists(F.slice(good, 1, i), lambda y: y["element"] == x["element"]))
    warn = F.exists(first, lambda x: x["rating"] != "RELEVAN") | F.coalesce(r["perlu_warning"], F.lit(False))
    return F.when(F.size(first) > 0, F.struct(first.alias("items"), warn.alias("warn")))


def dependents(changed: Column, graph: dict[str, Sequence[str]] = SECTION_DEPENDENTS) -> Column:
    """Sections that depend on changed ones and haven't been changed themselves, sorted."""
    m = F.create_map(*(x for k, v in graph.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    found = F.flatten(F.transform(changed, lambda s: F.coalesce(F.try_element_at(m, s), F.array().cast("array<string>"))))
    return F.array_sort(F.array_except(F.array_distinct(found), changed))


def changed_keys(before: Column, after: Column) -> Column:
    """Keys of after whose value isn't that of before, sorted."""
    return F.array_sort(F.filter(F.map_keys(after), lambda k: ~F.try_element_at(before, k).eqNullSafe(F.try_element_at(after, k))))


def banned_terms(text: Column) -> Column:
    """Codes of the terms that a formal text must not have outside quotations."""
    bare = F.regexp_replace(text, '"[^"]*"|“[^”]*”', " ")
    codes = F.array(F.when(bare.rlike(BANNED_TERM), F.lit("MURID_TERM_INVALID")), F.when(bare.rlike(INFORMAL_TERM), F.lit("FORMAL_LANGUAGE_INVALID")))
    return F.filter(codes, lambda c: c.isNotNull())


def book_identity(page: Column, meta_title: Column) -> Column:
    """struct(title, author, publisher, year, source): from the file's title, else from the first page."""
    given = strip(F.coalesce(meta_title, F.lit("")))
    meta = (F.length(given) >= 4) & ~F.lower(given).isin(*GENERIC_TITLES)
    lines = F.filter(F.transform(F.split(F.coalesce(page, F.lit("")), "\n"), strip), lambda x: F.length(x) >= 3)
    body = F.filter(lines, lambda x: ~x.rlike(NO_TITLE))
    some = F.filter(F.when(F.size(body) > 0, body).otherwise(lines), lambda x: (F.length(x) <= 120) & ~x.rlike(LETTERHEAD))
    # the longest, the first of these: by length, then by place
    longest = F.try_element_at(F.sort_array(F.transform(some, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x")))), F.lit(1))["x"]
    labelled = lambda words: F.substring(F.try_element_at(F.filter(F.transform(lines, lambda x: strip(F.regexp_extract(x, f"(?i)^(?:{words})\\s*[:\\-]?\\s*(.+)", 1))), lambda v: F.length(v) >= 3), F.lit(1)), 1, 120)
    inline = F.nullif(strip(F.regexp_extract(F.coalesce(page, F.lit("")), r"(?i)(?:penulis|disusun oleh|karya)\s*:\s*([A-Z][A-Za-z.'\s]{2,60}?)(?=\s+(?:editor|ilustrator|desain|penerbit|cetakan|tahun|hak|kata)|,|\.|$)", 1)), F.lit(""))
    year = F.nullif(F.regexp_extract(F.coalesce(page, F.lit("")), r"\b((?:19|20)\d{2})\b", 1), F.lit(""))
    title = F.when(meta, given).otherwise(title_case(longest))
    out = lambda c: F.when(~meta, c)
    return F.struct(title.alias("title"), out(F.coalesce(labelled("oleh|penulis|disusun oleh|karya"), inline)).alias("author"), out(labelled("penerbit|diterbitkan oleh")).alias("publisher"), out(year).alias("year"), F.when(meta, "metadata").when(title.isNotNull(), "halaman_judul").alias("source"))


def plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s]", " ")


def page_metrics(pairs: DataFrame, stored: str, fresh: str) -> DataFrame:
    """pairs with containment, similarity_raw and similarity_fair of two readings of a page."""
    ship(pairs.sparkSession)
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    words = lambda c: F.regexp_extract_all(low(c), F.lit("[a-z0-9]+"), F.lit(0))
    kept = F.array_join(F.filter(F.split(F.coalesce(fresh, F.lit("")), "\n"), lambda x: ~is_debris(x)), "\n")
    own, met = F.array_distinct(words(F.col(stored))).alias("__own"), plain_similarities(low(F.col(stored)), low(F.col(fresh)), low(kept)).alias("__met")
    share = F.when(F.size("__own") > 0, F.size(F.array_intersect("__own", "__other")) * 100.0 / F.size("__own")).otherwise(0.0)
    worked = pairs.select("*", own, words(F.col(fresh)).alias("__other"), met)  # each once, however often it is used
    return worked.select(*pairs.columns, share.alias("containment"), F.col("__met.first").alias("similarity_raw"), F.col("__met.second").alias("similarity_fair"))


def mean_metrics(pages: DataFrame, key: str) -> DataFrame:
    return pages.groupBy(key).agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("containment", "similarity_raw", "similarity_fair")))


def phases_of(activities: DataFrame) -> DataFrame:
    """module and its activities by experience; old kinds are mapped, what is unknown is applied."""
    old = {"pendahuluan": "memahami", "inti": "mengaplikasi", "penutup": "merefleksi", "memahami": "memahami", "mengaplikasi": "mengaplikasi", "merefleksi": "merefleksi"}
    kind = F.coalesce(lookup(old, F.lower("experience")), F.lit("mengaplikasi"))
    return activities.groupBy("module", kind.alias("experience")).agg(F.array_sort(F.collect_list("id")).alias("activities"))


def rubric_rows(criteria: Column, levels: Column) -> Column:
    """A row per level with the criterion whose turn it is."""
    return F.transform(levels, lambda x, i: F.struct(x.alias("level"), F.get(criteria, i % F.size(criteria)).alias("descriptor")))


def first_sentences(text: Column, n: int = 2, limit: int = 600) -> Column:
    return F.substring(F.array_join(F.slice(F.split(strip(text), r"(?<=[.!?])\s+"), 1, n), " "), 1, limit)


def resolved_dimensions(chosen: Column, allowed: Sequence[str], fallback: Sequence[str]) -> Column:
    """The chosen values that are allowed, in order; the fallback if there are none."""
    kept = F.array_intersect(F.coalesce(chosen, F.array().cast("array<string>")), F.array(*map(F.lit, allowed)))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(*map(F.lit, fallback)))


def principles_by_meeting(meetings: DataFrame, principles: DataFrame) -> DataFrame:
    """meetings with the last principles (meeting, seq, mindful, meaningful, joyful) that are all given."""
    whole = principles.where(present(F.col("mindful")) & present(F.col("meaningful")) & present(F.col("joyful")))
    last = whole.groupBy("meeting").agg(F.max_by(F.struct("mindful", "meaningful", "joyful"), "seq").alias("principles"))
    return meetings.join(last, "meeting", "left")


def insertions(items: DataFrame, activities: DataFrame) -> DataFrame:
    """items (module, pos, text, tp_ids) that aren't blank, with an id and the activities of their TPs in order."""
    from pyspark.sql import Window

    kept = items.where(present(strip(F.col("text"))))
    n = F.row_number().over(Window.partitionBy("module").orderBy("pos"))
    kept = kept.withColumn("id", F.concat(F.lit("kbc-ins-"), F.lpad(n.cast("string"), 2, "0")))
    linked = kept.select("module", "id", F.posexplode("tp_ids").alias("k", "tp_id")).join(activities.select("module", "tp_id", "activity_id", F.col("pos").alias("at")), ["module", "tp_id"])
    own = linked.groupBy("module", "id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("k", "at", "activity_id"))), lambda x: x["activity_id"])).alias("activities"))
    return kept.join(own, ["module", "id"], "left").withColumn("activities", F.coalesce("activities", F.array().cast(own.schema["activities"].dataType)))


def paired(themes: DataFrame, items: DataFrame) -> DataFrame:
    """themes and items (module, theme, pos) paired within a theme, each once; others stay alone."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("module", "theme").orderBy("pos"))
    a = themes.withColumn("n", n).select("module", "theme", "n", F.col("pos").alias("theme_pos"))
    b = items.withColumn("n", n).select("module", "theme", "n", F.col("pos").alias("item_pos"))
    return a.join(b, ["module", "theme", "n"], "full").drop("n")


def request_errors(fields: dict[str, int], required: Sequence[str]) -> Column:
    """Codes of the limits that a request's text fields break."""
    checks = [F.when(F.length(F.col(c)) > n, F.lit(f"{c}: too long")) for c, n in fields.items()]
    checks += [F.when(F.contains(F.coalesce(F.col(c), F.lit("")), F.lit("\u0000")), F.lit(f"{c}: null byte")) for c in fields]
    checks += [F.when(~present(F.col(c)), F.lit(f"{c}: missing")) for c in required]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def candid_opening(text: Column) -> Column:
    return strip(text).rlike(FAKE_CANDID)


def unknown_sections(changed: Column, allowed: Sequence[str]) -> Column:
    return F.array_except(changed, F.array(*map(F.lit, allowed)))


def holds(text: Column, phrases: Sequence[str]) -> Column:
    """Whether a text has one of some phrases, whatever its case."""
    return any_of(F.lower(text), [p.lower() for p in phrases])
