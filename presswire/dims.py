"""Small dimension tables. They are of fixed size, so they may be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The nine-point scale.
BIAS_LABELS = {
    -4: "Far Left",
    -3: "Left",
    -2: "Lean Left",
    -1: "Slight Left",
    0: "Center",
    1: "Slight Right",
    2: "Lean Right",
    3: "Right",
    4: "Far Right",
}

# Rated domains (domain, bias, factual rating, name, category).
RATED_DOMAINS = [
    ("reuters.com", 0, "high", "Reuters", None),
    ("apnews.com", 0, "high", "Associated Press", None),
    ("c-span.org", 0, "high", "C-SPAN", None),
    ("thehill.com", 0, "mostly_factual", "The Hill", None),
    ("npr.org", -1, "high", "NPR", None),
    ("bbc.com", -1, "high", "BBC", None),
    ("bbc.co.uk", -1, "high", "BBC", None),
    ("pbs.org", -1, "high", "PBS", None),
    ("nytimes.com", -2, "high", "New York Times", None),
    ("washingtonpost.com", -2, "high", "Washington Post", None),
    ("cnn.com", -2, "mixed", "CNN", None),
    ("theguardian.com", -2, "mostly_factual", "The Guardian", None),
    ("politico.com", -2, "mostly_factual", "Politico", None),
    ("msnbc.com", -3, "mixed", "MSNBC", None),
    ("huffpost.com", -3, "mostly_factual", "HuffPost", None),
    ("vox.com", -3, "mostly_factual", "Vox", None),
    ("slate.com", -3, "mostly_factual", "Slate", None),
    ("jacobin.com", -4, "mostly_factual", "Jacobin", None),
    ("truthout.org", -4, "mostly_factual", "TruthOut", None),
    ("commondreams.org", -4, "mostly_factual", "Common Dreams", None),
    ("realclearpolitics.com", 1, "mostly_factual", "RealClearPolitics", None),
    ("axios.com", 1, "high", "Axios", None),
    ("wsj.com", 2, "mostly_factual", "Wall Street Journal", None),
    ("nypost.com", 2, "mixed", "New York Post", None),
    ("washingtonexaminer.com", 2, "mostly_factual", "Washington Examiner", None),
    ("foxnews.com", 3, "mixed", "Fox News", None),
    ("dailywire.com", 3, "mostly_factual", "Daily Wire", None),
    ("nationalreview.com", 3, "mostly_factual", "National Review", None),
    ("theblaze.com", 3, "mixed", "The Blaze", None),
    ("breitbart.com", 4, "mixed", "Breitbart", None),
    ("thegatewaypundit.com", 4, "low", "Gateway Pundit", None),
    ("infowars.com", 4, "very_low", "InfoWars", None),
    ("reason.com", 0, "mostly_factual", "Reason", "libertarian"),
    ("mises.org", 0, "mostly_factual", "Mises Institute", "libertarian"),
    ("fee.org", 1, "mostly_factual", "FEE", "libertarian"),
    ("antiwar.com", 0, "mostly_factual", "Antiwar.com", "libertarian"),
    ("theintercept.com", -2, "high", "The Intercept", "independent"),
    ("zerohedge.com", 2, "mixed", "Zero Hedge", "independent"),
    ("taibbi.substack.com", 0, "mostly_factual", "Matt Taibbi", "independent"),
    ("greenwald.substack.com", 0, "mostly_factual", "Glenn Greenwald", "independent"),
    ("joerogan.com", 0, "mixed", "Joe Rogan", "alternative"),
    ("timcast.com", 2, "mixed", "Tim Pool", "alternative"),
    ("breakingpoints.com", 0, "mostly_factual", "Breaking Points", "alternative"),
]
RATED_SCHEMA = "domain string, bias int, factual string, name string, category string"

# Feeds (category, name, url, bias).
FEEDS = [
    ("center", "Reuters", "https://www.reutersagency.com/feed/?taxonomy=best-topics&post_type=best", 0),
    ("center", "Associated Press", "https://rsshub.app/apnews/topics/apf-topnews", 0),
    ("center", "C-SPAN", "https://www.c-span.org/podcasts/rss", 0),
    ("slight_left", "NPR", "https://feeds.npr.org/1001/rss.xml", -1),
    ("slight_left", "BBC", "http://feeds.bbci.co.uk/news/world/us_and_canada/rss.xml", -1),
    ("lean_left", "New York Times", "https://rss.nytimes.com/services/xml/rss/nyt/HomePage.xml", -2),
    ("lean_left", "New York Times Politics", "https://rss.nytimes.com/services/xml/rss/nyt/Politics.xml", -2),
    ("lean_left", "New York Times U.S.", "https://rss.nytimes.com/services/xml/rss/nyt/US.xml", -2),
    ("lean_left", "Washington Post", "https://feeds.washingtonpost.com/rss/politics", -2),
    ("lean_left", "CNN", "http://rss.cnn.com/rss/cnn_topstories.rss", -2),
    ("left", "MSNBC", "https://www.msnbc.com/feeds/latest", -3),
    ("left", "HuffPost", "https://www.huffpost.com/section/politics/feed", -3),
    ("far_left", "Jacobin", "https://jacobin.com/feed", -4),
    ("slight_right", "The Hill", "https://thehill.com/feed/", 1),
    ("slight_right", "RealClearPolitics", "https://www.realclearpolitics.com/index.xml", 1),
    ("lean_right", "Wall Street Journal", "https://feeds.a.dj.com/rss/RSSOpinion.xml", 2),
    ("lean_right", "New York Post", "https://nypost.com/feed/", 2),
    ("right", "Fox News", "https://moxie.foxnews.com/google-publisher/politics.xml", 3),
    ("right", "Daily Wire", "https://www.dailywire.com/feeds/rss.xml", 3),
    ("right", "National Review", "https://www.nationalreview.com/feed/", 3),
    ("far_right", "Breitbart", "https://feeds.feedburner.com/breitbart", 4),
    ("libertarian", "Reason", "https://reason.com/feed/", 0),
    ("libertarian", "Mises Institute", "https://mises.org/feed/wire", 0),
    ("libertarian", "Antiwar.com", "https://www.antiwar.com/feed/", 0),
    ("independent", "The Intercept", "https://theintercept.com/feed/?lang=en", -2),
    ("independent", "Zero Hedge", "https://feeds.feedburner.com/zerohedge/feed", 2),
    ("independent", "Glenn Greenwald", "https://greenwald.substack.com/feed", 0),
    ("fringe_conspiracy", "InfoWars (Alex Jones Show)", "https://rss.infowars.com/Alex.xml", 4),
    ("fringe_conspiracy", "InfoWars (Hourly Audio)", "https://rss.infowars.com/hourly/InfowarsHourlyAudio.xml", 4),
    ("fringe_conspiracy", "The Corbett Report (Articles)", "https://www.corbettreport.com/articlerss.xml", 1),
    ("fringe_conspiracy", "The Corbett Report (News)", "https://www.corbettreport.com/newrss.xml", 1),
    ("religion_spiritual", "Catholic News Agency", "https://www.catholicnewsagency.com/rss/news.xml", 0),
    ("religion_spiritual", "USCCB News Releases", "https://www.usccb.org/news/rss/index.cfm", 0),
    ("religion_spiritual", "National Catholic Register", "https://ncregister.com/feeds/general-news.xml", 0),
    ("religion_spiritual", "National Catholic Reporter", "http://ncronline.org/rss.xml", 0),
    ("supernatural", "Mysterious Universe (Podcast)", "https://mysteriousuniverse.org/feed/podcast", 0),
    ("supernatural", "Coast to Coast AM (Podcast)", "https://rss.premiereradio.net/podcast/coast.xml", 0),
]
FEED_SCHEMA = "feed_pos int, category string, name string, url string, bias int"

# Words that name a domain's feeds.
DOMAIN_HINTS = [
    ("nytimes.com", ["new york times", "nyt", "rss.nytimes.com"]),
    ("washingtonpost.com", ["washington post", "feeds.washingtonpost.com"]),
    ("cnn.com", ["cnn", "rss.cnn.com"]),
    ("foxnews.com", ["fox news", "foxnews"]),
    ("wsj.com", ["wall street journal", "a.dj.com"]),
]

# Labels of the rating site, in the order in which they are looked for.
SITE_LABELS = [
    ("far left", -4),
    ("left", -3),
    ("lean left", -2),
    ("center", 0),
    ("lean right", 2),
    ("right", 3),
    ("far right", 4),
    ("mixed", 0),
]

# Provider prefixes of model ids, the prefix used when calling, and the setting that holds the key.
PROVIDERS = [
    ("openrouter", ["openrouter"], "openrouter", "OPENROUTER_API_KEY"),
    ("gemini", ["gemini"], "gemini", "GOOGLE_API_KEY"),
    ("anthropic", ["anthropic"], "anthropic", "ANTHROPIC_API_KEY"),
    ("groq", ["groq"], "groq", "GROQ_API_KEY"),
    ("openai", ["openai"], "openai", "OPENAI_API_KEY"),
    ("lmstudio", ["lmstudio", "lm_studio"], "lm_studio", "LM_STUDIO_API_KEY"),
    ("grok", ["grok", "xai"], "xai", "XAI_API_KEY"),
    ("cerebras", ["cerebras"], "cerebras", "CEREBRAS_API_KEY"),
    ("sambanova", ["sambanova"], "sambanova", "SAMBANOVA_API_KEY"),
    ("mistral", ["mistral"], "mistral", "MISTRAL_API_KEY"),
    ("ollama", ["ollama"], "ollama", None),
]

#: Outlets of the test tables (src0, src1, ...) that have a rating; the others stay unknown.
RATED_OUTLETS = 18


def rated_domains(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RATED_DOMAINS, RATED_SCHEMA)


def feeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *f) for i, f in enumerate(FEEDS)], FEED_SCHEMA)


def outlet_bias(spark: SparkSession) -> DataFrame:
    """outlet, bias, category: the rule that rates the test tables' outlets."""
    n = F.col("id").cast("int")
    return spark.range(RATED_OUTLETS).select(
        F.concat(F.lit("src"), n.cast("string")).alias("outlet"),
        (F.pmod(n, F.lit(9)) - 4).alias("bias"),
        F.when(F.pmod(n, F.lit(6)) == 0, "libertarian").when(F.pmod(n, F.lit(6)) == 1, "independent").alias("category"),
    )


#: The same as SQL, for the oracles.
OUTLET_SQL = f"""(select 'src' || i as outlet, (i % 9)::integer - 4 as bias,
  case when i % 6 = 0 then 'libertarian' when i % 6 = 1 then 'independent' end as category from range({RATED_OUTLETS}) r(i))"""


def literal(value) -> str:
    """A value as a SQL literal."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(literal, value)) + "]"
    text = str(value)
    if "\n" in text or "\r" in text or "\t" in text:
        for char, code in (("\n", 10), ("\r", 13), ("\t", 9)):
            text = text.replace(char, f"\0{code}\0")
        parts = text.split("\0")
        return "(" + " || ".join(f"chr({p})" if i % 2 else literal(p) for i, p in enumerate(parts)) + ")"
    return "'" + text.replace("'", "''") + "'"


def values_sql(rows: list[tuple], columns: str) -> str:
    """A fixture's rows as a SQL table, for the oracles."""
    return f"(select * from (values {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) fixture({columns}))"
