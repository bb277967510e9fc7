"""Filter, search and text queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.functions import text as T
from lumenframe.functions import timecode as TC
from lumenframe.operators import filters, ranking
from lumenframe.plans.common import EV, events, orders
from lumenframe.session import table

r6 = lambda c: F.round(c, 6)
QUERY = ["the", "erth", "de", "que"]
PROFANE = ["the", "and", "idiot"]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def query_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by a built filter, dearest first."""
    return filters.build_query(table(spark, sf_dir, "part"), {"p_name": "%ring%"}, {"p_type": "PROMO"}, {"p_size": 10}, "p_retailprice").select("p_partkey", "p_name", "p_size")


def clip_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with a size from 5 to 30, a price under 1500, and all of two words in the name."""
    words = F.split("p_name", " ")
    rows = table(spark, sf_dir, "part").withColumn("w", words)
    return rows.where(filters.all_of([filters.between_optional("p_size", 5, 30), filters.between_optional("p_retailprice", None, 1500.0), filters.has_all("w", ["small", "ring"])])).select("p_partkey", "p_size")


def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with both terms in the name, brand or type."""
    return table(spark, sf_dir, "part").where(filters.contains_all_terms(["p_name", "p_brand", "p_type"], ["RING", "brand#1"])).select("p_partkey")


def boolean_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by a query with fields, ranges, phrases, negation and alternatives."""
    asked = '("small ring" OR widget) AND p_size:5..20 -p_type:promo NOT p_brand:brand#2'
    return table(spark, sf_dir, "part").where(filters.parse_search(asked, ["p_name", "p_type"])).select("p_partkey")


def log_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of severity warning or higher with a 7 in their item."""
    level = F.when(F.col("event_type") == "error", 3).when(F.col("value") > 150, 2).otherwise(1)
    return events(spark, sf_dir).where((level >= 2) & F.lower("props").contains("7")).select("event_id")


def smart_playlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 parts within bounds, in the order of their keys."""
    return table(spark, sf_dir, "part").where(F.col("p_size").between(3, 25) & F.col("p_retailprice").between(900, 1400)).orderBy("p_partkey").limit(20).select("p_partkey")


def territory_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in a listed nation or in a nation of a listed region."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    zone = n.where(F.col("n_name").isin("NATION_3", "NATION_7") | (F.col("r_name") == "AFRICA")).select("n_nationkey")
    return table(spark, sf_dir, "customer").join(F.broadcast(zone), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey")


def geo_restriction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that a block list and an allow list let pass."""
    ok = filters.geo_allowed(F.col("n_name"), ["nation_1", "nation_2", "nation_3"], ["NATION_2"])
    return table(spark, sf_dir, "nation").select("n_nationkey", ok.alias("allowed"))


def quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by grade of the value."""
    grade = filters.ladder(F.col("value"), [(200.0, "A"), (100.0, "B"), (50.0, "C"), (10.0, "D")], "F")
    return events(spark, sf_dir).groupBy(grade.alias("grade")).agg(F.count("*").alias("n"))


def route_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and number from the path of a page."""
    path = F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1)
    found = T.route_params("/{lang}/{number}", F.regexp_replace(path, "/$", ""))
    return table(spark, sf_dir, "pages").select("page_id", found["lang"].alias("lang"), found["number"].alias("number"))


def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight most frequent values of language and source."""
    return ranking.facets(_docs(spark, sf_dir), ["lang", "source"], 8)


def postings_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 terms that most documents hold, with their occurrences."""
    posts = ranking.postings(_docs(spark, sf_dir), "doc_id", {"text": 1.0})
    return posts.groupBy("term").agg(F.countDistinct("doc").alias("df"), F.count("*").alias("cf")).orderBy(F.desc("df"), "term").limit(50)


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents by BM25."""
    scored = ranking.bm25(_docs(spark, sf_dir), "doc_id", "text", QUERY).withColumn("score", r6("score"))
    return ranking.top(scored, "score", "doc", 20).withColumn("rank", F.col("rank").cast("long"))


def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents by TF-IDF."""
    scored = ranking.tf_idf(_docs(spark, sf_dir), "doc_id", "text", QUERY).withColumn("score", r6("score"))
    return ranking.top(scored, "score", "doc", 20).withColumn("rank", F.col("rank").cast("long"))


def log_tfidf_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of log TF-IDF by their maximum."""
    scored = ranking.normalised(ranking.log_tf_idf(_docs(spark, sf_dir), "doc_id", "text", QUERY), "score")
    return scored.select("doc", r6("score").alias("score"))


def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a phrase."""
    return ranking.phrase_hits(_docs(spark, sf_dir), "doc_id", "text", ["of", "the"])


def autocomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent words with a prefix."""
    return ranking.autocomplete(ranking.vocabulary(_docs(spark, sf_dir), "text"), "th", 10)


def spell_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words near three misspelt ones."""
    asked = spark.createDataFrame([("thier",), ("tion",), ("wiht",)], "word string")
    vocab = ranking.vocabulary(_docs(spark, sf_dir), "text").where("n >= 5 and term rlike '^[a-z]+$'")
    return ranking.suggest(vocab, asked).withColumn("score", r6("score"))


def auto_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best correction of four words."""
    asked = spark.createDataFrame([("thier",), ("tion",), ("wiht",), ("qqqqqqqqq",)], "word string")
    vocab = ranking.vocabulary(_docs(spark, sf_dir), "text").where("n >= 5 and term rlike '^[a-z]+$'")
    return ranking.auto_correct(vocab, asked)


def weighted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by the weights of the fields that hold a term."""
    return ranking.weighted_contains(table(spark, sf_dir, "part"), {"p_name": 2.0, "p_type": 1.0, "p_brand": 0.5}, "r").select("p_partkey", "score")


def search_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as queries: how often, first and last time, mean value of each."""
    return events(spark, sf_dir).groupBy(F.lower("event_type").alias("query"), "k").agg(F.count("*").alias("n"), F.min("t").alias("first_us"), F.max("t").alias("last_us"), r6(F.avg("value")).alias("mean"))


def text_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of pages without tags, with blanks in one and entities decoded."""
    clean = T.decode_entities(T.normalize_blanks(T.strip_tags(F.col("html"))))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(clean).alias("digest"), F.char_length(clean).cast("long").alias("n"))


def url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical URLs of the pages."""
    return table(spark, sf_dir, "pages").select("page_id", T.cache_key(F.col("url")).alias("key"))


def caption_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, signs and reading speed of the turns, each lasting 60 ms a sign, and the turns that are too fast."""
    rows = table(spark, sf_dir, "conversations").withColumn("ms", F.char_length("text") * 60)
    rate = T.words_per_second(F.col("text"), F.col("ms"))
    return rows.groupBy("role").agg(
        F.sum(T.word_count(F.col("text"))).alias("words"), F.sum(F.char_length(F.regexp_replace("text", "\\s", ""))).alias("signs"), r6(F.avg(rate)).alias("rate"), F.sum((rate > 2.6).cast("long")).alias("fast")
    )


def profanity_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations that hold a listed word, masked."""
    rows = table(spark, sf_dir, "conversations").where(T.has_word(F.col("text"), PROFANE))
    return rows.select("conv_id", "turn", F.md5(T.mask_words(F.col("text"), PROFANE)).alias("digest"))


def mojibake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by signs of a wrong charset."""
    return _docs(spark, sf_dir).groupBy(T.has_mojibake(F.col("text")).alias("broken")).agg(F.count("*").alias("n"))


def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of the words of the parts."""
    each = table(spark, sf_dir, "part").select(F.explode(F.split(F.concat_ws(" ", "p_name", F.lit("rings boxed slowly flies process Reseed mixes")), " ")).alias("word")).distinct()
    return each.select("word", T.stem(F.col("word")).alias("stem"))


def parsed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bit rates and resolutions of strings made from the parts."""
    rate = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "M").when(F.col("p_partkey") % 3 == 1, "k").otherwise("x"))
    size = T.parse_resolution(F.concat(F.col("p_size") * 16, F.lit("x"), F.col("p_size") * 9))
    return table(spark, sf_dir, "part").select("p_partkey", T.parse_bitrate(rate).alias("bps"), size["width"].alias("width"), size["height"].alias("height"))


def validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a valid URL, and whether their host makes an address."""
    mail = F.concat(F.lit("info@"), F.regexp_extract("url", "^https?://([^/]+)", 1))
    return table(spark, sf_dir, "pages").groupBy(T.valid_url(F.col("url")).alias("url_ok"), T.valid_email(mail).alias("mail_ok")).agg(F.count("*").alias("n"))


def file_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes as text."""
    return orders(spark, sf_dir).select("o_orderkey", T.file_size(F.floor("o_totalprice") * F.lit(37)).alias("size"))


def timecodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timecodes of order numbers and back."""
    frames = F.col("o_orderkey") * 97
    code = TC.smpte(frames, 25)
    return orders(spark, sf_dir).select("o_orderkey", code.alias("code"), TC.parse_smpte(code, 25).alias("frames"), TC.feet_frames(frames).alias("feet"), TC.frame_parts(frames, 25)["m"].alias("minute"))


def retimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Milliseconds re-timed from 25 to 30 frames a second, and stretched about an anchor."""
    ms = F.col("o_orderkey") * 40
    return orders(spark, sf_dir).select("o_orderkey", TC.retime(ms, 25.0, 30.0).alias("ms"), TC.stretch(ms, 0, 1.25).alias("stretched"))


def standard_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest standard frame rate of each size."""
    return table(spark, sf_dir, "part").select(F.col("p_size").alias("fps")).distinct().select("fps", T.standard_rate(F.col("fps").cast("double")).alias("rate"))


def page_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of 15 parts by price."""
    return filters.page(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), F.col("p_partkey")], 3, 15)


def tag_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with all of two words, with either, and the words that stand beside one."""
    from lumenframe.operators import similarity as S

    bridge = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("tag"))
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    both = count(S.tags_all(bridge, "p_partkey", "tag", ["small", "ring"]), "all").unionAll(count(S.tags_any(bridge, "p_partkey", "tag", ["small", "ring"]), "any"))
    return both.unionAll(S.co_tags(bridge, "p_partkey", "tag", "ring").select(F.concat(F.lit("beside "), "tag").alias("kind"), "n"))


def top_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent words of part names."""
    return table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(10)


_W = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '')"
_VOC = f"voc as (select term, count(*) n from (select unnest({_W}) term from documents) group by 1)"
_QC = f"""d as (select doc_id as doc, {_W} w from documents), x as (select doc, len(w) len, unnest(w) term from d), c as (select doc, len, term, count(*) tf from x where term in ('the', 'erth', 'de', 'que') group by all),
        f as (select term, count(*) df from c group by 1), k as (select count(*) n, avg(len(w)) a from d)"""
QUERIES = {
    "query_builder": (query_builder, "select p_partkey, p_name, p_size from part where p_name like '%ring%' and p_type = 'PROMO' and p_size >= 10"),
    "clip_filter": (clip_filter, "select p_partkey, p_size from part where p_size between 5 and 30 and p_retailprice <= 1500 and list_has_all(string_split(p_name, ' '), ['small', 'ring'])"),
    "keyword_search": (keyword_search, "select p_partkey from part where (lower(p_name) like '%ring%' or lower(p_brand) like '%ring%' or lower(p_type) like '%ring%') and (lower(p_brand) like '%brand#1%')"),
    "boolean_search": (boolean_search, "select p_partkey from part where (lower(p_name) like '%small ring%' or lower(p_type) like '%small ring%' or lower(p_name) like '%widget%') and p_size between 5 and 20 and p_type <> 'PROMO' and p_brand <> 'Brand#2'"),
    "log_search": (log_search, "select event_id from events where (event_type = 'error' or value > 150) and props like '%7%'"),
    "smart_playlist": (smart_playlist, "select p_partkey from part where p_size between 3 and 25 and p_retailprice between 900 and 1400 order by p_partkey limit 20"),
    "territory_zone": (territory_zone, "select c_custkey from customer where c_nationkey in (select n_nationkey from nation join region on n_regionkey = r_regionkey where n_name in ('NATION_3', 'NATION_7') or r_name = 'AFRICA')"),
    "geo_restriction": (geo_restriction, "select n_nationkey, n_name in ('NATION_1', 'NATION_3') allowed from nation"),
    "quality_grades": (quality_grades, "select case when value >= 200 then 'A' when value >= 100 then 'B' when value >= 50 then 'C' when value >= 10 then 'D' else 'F' end grade, count(*) n from events group by 1"),
    "route_params": (route_params, "select page_id, nullif(regexp_extract(url, '^https?://[^/]+/([^/?#]+)/([^/?#]+)', 1), '') lang, nullif(regexp_extract(url, '^https?://[^/]+/([^/?#]+)/([^/?#]+)', 2), '') as number from pages"),
    "facet_counts": (facet_counts, """with e as (select 'lang' field, lang as value from documents union all select 'source', source from documents), c as (select field, value, count(*) n from e where value is not null group by 1, 2)
        select field, value, n from c qualify row_number() over (partition by field order by n desc, value) <= 8"""),
    "postings_frequency": (postings_frequency, f"with x as (select doc_id, unnest({_W}) term from documents) select term, count(distinct doc_id) df, count(*) cf from x group by 1 order by df desc, term limit 50"),
    "bm25_topk": (bm25_topk, f"""with {_QC}, s as (select doc, round(sum(ln((n - df + 0.5::double) / (df + 0.5::double) + 1) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * len / a))), 6) score from c join f using (term), k group by 1)
        select doc, score, row_number() over (order by score desc, doc) as rank from s order by score desc, doc limit 20"""),
    "tfidf_topk": (tfidf_topk, f"""with {_QC}, s as (select doc, round(sum(tf / len * ln(n / df + 1)), 6) score from c join f using (term), k group by 1) select doc, score, row_number() over (order by score desc, doc) as rank from s order by score desc, doc limit 20"""),
    "log_tfidf_normalised": (log_tfidf_normalised, f"""with {_QC}, s as (select doc, sum((1 + ln(tf)) * greatest(ln(n / df), 0)) score from c join f using (term), k group by 1) select doc, round(score / (select max(score) from s), 6) score from s"""),
    "phrase_search": (phrase_search, f"""with d as (select doc_id doc, {_W} w from documents), x as (select doc, w, unnest(range(1, len(w))) i from d) select doc, i - 1 as pos from x where w[i] = 'of' and w[i + 1] = 'the'"""),
    "autocomplete": (autocomplete, f"with {_VOC} select term, n from voc where starts_with(term, 'th') order by n desc, term limit 10"),
    "spell_suggest": (spell_suggest, f"""with {_VOC}, q as (select unnest(['thier', 'tion', 'wiht']) word) select word, term, round(1 - levenshtein(word, term) / greatest(length(word), length(term)), 6) score
        from voc, q where n >= 5 and regexp_matches(term, '^[a-z]+$') and term <> word and levenshtein(word, term) <= 2"""),
    "auto_correct": (auto_correct, f"""with {_VOC}, q as (select unnest(['thier', 'tion', 'wiht', 'qqqqqqqqq']) word), s as (select word, term, 1 - levenshtein(word, term) / greatest(length(word), length(term)) score
        from voc, q where n >= 5 and regexp_matches(term, '^[a-z]+$') and term <> word and levenshtein(word, term) <= 2), b as (select word, term from s qualify row_number() over (partition by word order by score desc, term) = 1)
        select word, coalesce(term, word) corrected from q left join b using (word)"""),
    "weighted_fields": (weighted_fields, """with s as (select p_partkey, 2.0::double * (lower(p_name) like '%r%')::int + 1.0::double * (lower(p_type) like '%r%')::int + 0.5::double * (lower(p_brand) like '%r%')::int score from part) select * from s where score > 0"""),
    "search_history": (search_history, f"with {EV} select lower(event_type) as query, k, count(*) n, min(t) first_us, max(t) last_us, round(avg(value), 6) mean from ev group by 1, 2"),
    "text_sanitize": (text_sanitize, """with c as (select page_id, replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<[^>]*(>|$)', '', 'g'), '[ \\t]+', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&quot;', '"'), '&apos;', ''''), '&nbsp;', ' ') t from pages)
        select page_id, md5(t) digest, length(t) n from c"""),
    "url_keys": (url_keys, """with p as (select page_id, lower(split_part(url, '#', 1)) u from pages), q as (select page_id, split_part(u, '?', 1) path, array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda x: x <> '')), '&') ps from p),
        s as (select page_id, ps, case when regexp_matches(path, '^[a-z]+://[^/]+/$') then path else regexp_replace(path, '/$', '') end path from q) select page_id, case when ps = '' then path else path || '?' || ps end as key from s"""),
    "caption_stats": (caption_stats, """with c as (select role, text, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) w from conversations), r as (select *, case when w > 0 and length(text) > 0 then w / (length(text) * 60 / 1000.0::double) end rate from c)
        select role, sum(w)::bigint words, sum(length(regexp_replace(text, '\\s', '', 'g')))::bigint signs, round(avg(rate), 6) rate, sum((rate > 2.6)::bigint)::bigint fast from r group by 1"""),
    "profanity_mask": (profanity_mask, """select conv_id, turn, md5(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\\bthe\\b', '***', 'g'), '(?i)\\band\\b', '***', 'g'), '(?i)\\bidiot\\b', '*****', 'g')) digest from conversations where regexp_matches(text, '(?i)\\b(the|and|idiot)\\b')"""),
    "mojibake": (mojibake, "select regexp_matches(text, '�|Ã©|Ã¨|Ã¼|Ã¶|Ã¤|Â') broken, count(*) n from documents group by 1"),
    "stems": (stems, """with w as (select distinct unnest(string_split(p_name || ' rings boxed slowly flies process Reseed mixes', ' ')) word from part),
        a as (select word, lower(word) x from w), b as (select word, case when x like '%ing' and strlen(x) > 5 then x[:-4] else x end x from a), c as (select word, case when x like '%ed' and strlen(x) > 4 then x[:-3] else x end x from b),
        d as (select word, case when x like '%ly' and strlen(x) > 4 then x[:-3] else x end x from c), e as (select word, case when x like '%s' and strlen(x) > 3 then x[:-2] else x end x from d),
        f as (select word, case when x like '%es' and strlen(x) > 4 then x[:-3] else x end x from e) select word, case when x like '%ies' and strlen(x) > 5 then x[:-4] else x end stem from f"""),
    "parsed_values": (parsed_values, "select p_partkey, case p_partkey % 3 when 0 then p_size * 1000000::bigint when 1 then p_size * 1000::bigint end bps, p_size * 16 width, p_size * 9 height from part"),
    "validators": (validators, """select regexp_matches(url, '^(?:https?|ftp)://[^\\s/]+(?:/\\S*)?$') url_ok, regexp_matches('info@' || regexp_extract(url, '^https?://([^/]+)', 1), '^[^@]+@[^@]+$') mail_ok, count(*) n from pages group by 1, 2"""),
    "file_sizes": (file_sizes, """with s as (select o_orderkey, floor(o_totalprice)::bigint * 37 b from orders) select o_orderkey, case when b >= 1073741824 then printf('%.2f GB', round(b / 1073741824.0::double, 2)) when b >= 1048576 then printf('%.2f MB', round(b / 1048576.0::double, 2))
        when b >= 1024 then printf('%.2f KB', round(b / 1024.0::double, 2)) else printf('%d B', b) end as size from s"""),
    "timecodes": (timecodes, """with f as (select o_orderkey, o_orderkey * 97 f from orders) select o_orderkey, printf('%02d:%02d:%02d:%02d', f // 90000, f // 1500 % 60, f // 25 % 60, f % 25) code, f as frames, printf('%d+%02d', f // 16, f % 16) feet, f // 1500 % 60 as minute from f"""),
    "retimed": (retimed, "select o_orderkey, round(o_orderkey * 40 * 25.0::double / 30.0::double)::bigint ms, round(o_orderkey * 40 * 1.25::double)::bigint stretched from orders"),
    "standard_rates": (standard_rates, """with p as (select distinct p_size fps from part), r as (select fps, unnest([23.976::double, 24, 25, 29.97, 30, 50, 59.94, 60]) r from p), b as (select fps, min((abs(fps - r), r)) m from r group by 1)
        select fps, case when m[1] > 0.5 then fps::double else m[2] end rate from b"""),
    "page_of_parts": (page_of_parts, "select p_partkey, p_retailprice from part order by p_retailprice desc, p_partkey limit 15 offset 30"),
    "tag_sets": (tag_sets, """with b as (select distinct p_partkey, unnest(string_split(p_name, ' ')) tag from part), m as (select p_partkey from b where tag = 'ring') select 'all' kind, count(*) n from (select p_partkey from b where tag in ('small', 'ring') group by 1 having count(*) = 2)
        union all select 'any', count(distinct p_partkey) from b where tag in ('small', 'ring') union all select 'beside ' || tag, count(*) from b where tag <> 'ring' and p_partkey in (select p_partkey from m) group by tag"""),
    "top_tags": (top_tags, "select tag, count(*) n from (select unnest(string_split(p_name, ' ')) tag from part) group by 1 order by n desc, tag limit 10"),
}
