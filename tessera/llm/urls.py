"""URL filter: rules first, else logistic regression on hashed character n-grams of host and path.

Rules are matched in column expressions: a rule ``host/path`` fits its host and all subdomains of it where the URL's
path starts with the rule's; the longest rule wins. URLs that no rule fits are judged by the model. It is trained on the
driver from the small labelled table below, of at most ``TABLE_ROWS`` rows, by Newton steps, without chance; only its
``2 ** BITS`` weights go to the executors.

Half of the table is to be blocked, but few of the URLs on the web are: the log-odds are shifted from the table's share to
``BASE_RATE``, so a host that looks like nothing in the table is allowed.

Nulls: a null URL, or one without ``://``, has an empty host and path; no rule fits it and the model allows it. Repeated
rows are judged each for itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS, SIZES, TABLE_ROWS = 14, (3, 4, 5), 20_000
PIECE = 1 << 18
RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]
BASE_RATE = 0.25
#: The labelled table: pages of betting, adult, advertising, pill, loan and piracy sites, to be blocked ...
BLOCKED = """
https://www.bet365.com/sports/betting https://www.888casino.com/online-casino/slots https://www.pokerstars.com/poker/games
https://www.betfair.com/exchange/betting https://www.bwin.com/en/sports/betting https://www.partypoker.com/poker/bonus
https://casino.betmgm.com/slots https://www.betway.com/casino/jackpot https://www.unibet.com/betting/odds
https://www.jackpotcitycasino.com/online-slots https://www.casino.com/roulette https://www.slotomania.com/slots
https://1xbet.com/en/line/football https://www.ggpoker.com/poker/bonus https://www.888poker.com/poker/bonus
https://www.paddypower.com/bet https://www.betvictor.com/casino https://www.leovegas.com/en-gb/casino/slots
https://www.casumo.com/casino https://mrgreen.com/casino/roulette https://www.sportsbet.com.au/betting/horse-racing
https://www.skycasino.com/jackpots https://www.partycasino.com/slots/jackpots https://www.royalvegascasino.com/bonus
https://www.spinpalace.com/casino/bonus https://stake.com/casino/slots https://www.betonline.ag/sportsbook
https://www.vegasslotsonline.com/free-slots https://www.slotsup.com/free-slots-online https://www.betsson.com/en/casino
https://www.pornhub.com/video https://www.xvideos.com/tags/porn https://xhamster.com/categories/sex
https://www.youporn.com/porntags https://www.redtube.com/pornstar https://www.xnxx.com/search/sex
https://www.adultfriendfinder.com/sex https://chaturbate.com/adult-cams https://www.livejasmin.com/en/sex-cams
https://www.sex.com/xxx/videos https://www.porn.com/videos https://www.tube8.com/porn https://spankbang.com/porn
https://www.eporner.com/best-porn https://www.literotica.com/sex-stories https://hqporner.com/hdporn
https://www.pornpics.com/xxx https://www.xxx.com/videos/xxx https://www.adulttime.com/en/videos https://bongacams.com/adult-cams
https://www.camsoda.com/adult-cams https://stripchat.com/sex-cams https://www.adultempire.com/adult-dvd https://www.sexlikereal.com/vr-porn
https://ad.doubleclick.net/ddm/clk https://pagead2.googlesyndication.com/pagead/ads https://ib.adnxs.com/click
https://googleads.g.doubleclick.net/pagead/adview https://www.popads.net/popunder https://adserver.adtech.de/adlink
https://ads.yahoo.com/click https://ads.pubmatic.com/adserver/js https://adclick.g.doubleclick.net/aclk
https://track.adform.net/adfserve https://www.clickbank.net/click https://tracking.admarketplace.net/tracking/click
https://click.linksynergy.com/fs-bin/click https://adfarm.mediaplex.com/ad/click https://www.propellerads.com/popunder
https://syndication.exoclick.com/ads https://ads.exoclick.com/banner https://www.adsterra.com/popunder
https://clicktrack.pubmatic.com/adserver/tracker https://d.adroll.com/click https://ads.linkedin.com/adserver
https://tracker.adition.com/click https://www.viagra.com/buy-viagra-online https://www.cialis.com/buy-cialis-online
https://www.canadapharmacy.com/buy/viagra https://www.canadianpharmacyonline.com/cheap-viagra
https://www.northwestpharmacy.com/buy-cialis-online https://www.rxpharmacyonline.com/cheap-pills
https://www.cashnetusa.com/payday-loans https://www.checkintocash.com/payday-loans https://www.speedycash.com/payday-loans
https://www.moneymutual.com/payday-loans https://www.advanceamerica.net/payday-loans https://thepiratebay.org/search/crack
https://1337x.to/torrent https://www.torrentdownloads.pro/torrent https://kickasstorrents.to/torrent
https://www.limetorrents.lol/torrents https://torrentz2.nz/torrents https://extratorrent.si/torrent
https://crackedpc.org/keygen-crack-download https://www.serials.ws/crack-keygen https://getintopc.com/crack-free-download
""".split()
#: ... and of ordinary sites, to be allowed.
ALLOWED = """
https://www.bbc.co.uk/news/world-europe https://www.theguardian.com/books/2019/mar/02/review https://www.reuters.com/markets
https://www.washingtonpost.com/opinions https://www.economist.com/leaders https://www.npr.org/sections/science
https://www.spiegel.de/politik/deutschland https://www.faz.net/aktuell/feuilleton https://www.sueddeutsche.de/kultur
https://www.tagesschau.de/inland https://www.lemonde.fr/planete/article https://www.lefigaro.fr/culture
https://www.liberation.fr/sciences https://elpais.com/cultura https://www.elmundo.es/ciencia https://www.lavanguardia.com/vida
https://www.corriere.it/cronache https://www.publico.pt/sociedade https://www.nrc.nl/nieuws https://www.dn.se/nyheter
https://de.wikipedia.org/wiki/Fluss https://fr.wikipedia.org/wiki/Montagne https://es.wiktionary.org/wiki/casa
https://www.britannica.com/science/cell https://www.nature.com/articles https://www.science.org/doi/full
https://arxiv.org/abs/1706.03762 https://www.sciencedirect.com/science/article https://link.springer.com/article
https://www.jstor.org/stable https://www.ncbi.nlm.nih.gov/pmc/articles https://www.who.int/news-room/fact-sheets
https://www.nasa.gov/missions https://www.noaa.gov/weather https://www.usgs.gov/programs/earthquake-hazards
https://www.census.gov/topics https://www.usda.gov/topics/farming https://www.farmers.gov/your-business
https://www.gov.uk/browse/benefits https://www.service-public.fr/particuliers https://www.bundestag.de/dokumente
https://europa.eu/european-union https://www.un.org/en/global-issues https://www.unesco.org/en/culture
https://web.mit.edu/research https://www.stanford.edu/admission https://www.ox.ac.uk/about https://www.essex.ac.uk/courses
https://www.sussex.ac.uk/study https://www.ethz.ch/de/forschung https://www.tum.de/studium https://www.sorbonne-universite.fr/formations
https://www.adelaide.edu.au/study https://www.u-tokyo.ac.jp/en/academics https://www.loc.gov/collections
https://www.gutenberg.org/ebooks https://archive.org/details/texts https://www.smithsonianmag.com/history
https://www.nationalgeographic.com/animals https://www.metmuseum.org/art/collection https://www.moma.org/calendar
https://stackoverflow.com/questions/tagged/java https://developer.mozilla.org/en-US/docs/Web https://www.rust-lang.org/learn
https://go.dev/doc https://www.postgresql.org/docs/current https://kernel.org/doc/html https://www.debian.org/releases
https://spark.apache.org/docs/latest https://numpy.org/doc/stable https://www.r-project.org/about.html
https://gitlab.com/explore https://hackaday.com/blog https://www.wired.com/story https://arstechnica.com/gadgets
https://www.allrecipes.com/recipe https://www.seriouseats.com/recipes https://www.chefkoch.de/rezepte https://www.marmiton.org/recettes
https://www.mayoclinic.org/diseases-conditions https://www.webmd.com/heart https://www.betterhealth.vic.gov.au/health
https://www.lonelyplanet.com/articles https://www.tripadvisor.com/tourism https://www.rei.com/learn https://www.ikea.com/gb/en
https://www.etsy.com/listing https://www.goodreads.com/book/show https://www.imdb.com/title https://www.espn.com/soccer/story
https://www.fifa.com/tournaments https://www.olympics.com/en/news https://www.weather.com/forecast https://www.khanacademy.org/math
https://www.coursera.org/learn https://www.openstreetmap.org/about https://www.adobe.com/products https://www.pharmacy.umich.edu/about
https://www.berlin.de/kultur https://www.paris.fr/pages/mobilite https://www.madrid.es/portal https://www.toronto.ca/services
""".split()


def url_table() -> list[tuple[str, int]]:
    """The labelled table: (url, 1 for block)."""
    return [(url, 1) for url in BLOCKED] + [(url, 0) for url in ALLOWED]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path; empty where there is none."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    known = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(known, "://([^/?#]*)", 1), capitals, capitals.lower())
    return host, F.regexp_extract(known, "://[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its action; null where none does."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        rule_host, slash, rest = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, verdict).otherwise(action)
    return rule, action


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of all n-grams of bytes; a row's values have length 1 together."""
    texts = [f"\x02{h}\x03\x04{p}\x05".encode() for h, p in zip(hosts, paths, strict=True)]
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    rows, which = [], []
    for n in SIZES:
        count = max(0, len(flat) - n + 1)
        same = owner[:count] == owner[n - 1 :]
        h = np.zeros(count, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + flat[k : k + count]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15 + 2 * n)
        rows.append(owner[:count][same])
        which.append((h >> np.uint64(64 - BITS)).astype(np.int64)[same])
    row, feature = np.concatenate(rows), np.concatenate(which)
    each = np.bincount(row, minlength=len(texts)).clip(1)
    return row, feature, 1 / np.sqrt(each)[row]


def train(table: list[tuple[str, int]], penalty: float = 0.01, steps: int = 12, base_rate: float = BASE_RATE) -> np.ndarray:
    """Weights of all features and, last, the intercept, shifted to the base rate.

    Newton steps in the space of the rows (the weights are a sum of the rows' features), so the matrices have the size
    of the table."""
    if len(table) > TABLE_ROWS:
        raise ValueError(f"the labelled table has more than {TABLE_ROWS} rows")
    hosts, paths = [], []
    for url, _ in table:
        rest = url.partition("://")[2]
        cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
        hosts.append(rest[:cut].lower())
        paths.append(rest[cut:].partition("?")[0].partition("#")[0])
    y = np.array([label for _, label in table], float)
    if not 0 < y.mean() < 1:
        raise ValueError("the labelled table needs rows of both kinds")
    row, feature, value = features(hosts, paths)
    x = np.zeros((len(table), (1 << BITS) + 1))
    np.add.at(x, (row, feature), value)
    x[:, -1] = 1
    gram = x @ x.T
    alpha = np.zeros(len(table))
    for _ in range(steps):
        z = gram @ alpha
        p = 1 / (1 + np.exp(-z))
        w = (p * (1 - p)).clip(1e-6)
        alpha = np.linalg.solve(gram + penalty * np.diag(1 / w), z + (y - p) / w)
    weights = x.T @ alpha
    weights[-1] += np.log(base_rate / (1 - base_rate)) - np.log(y.mean() / (1 - y.mean()))
    return weights


def score(weights: np.ndarray, hosts: list[str], paths: list[str]) -> np.ndarray:
    """Log-odds of block."""
    row, feature, value = features(hosts, paths)
    return np.bincount(row, weights[feature] * value, minlength=len(hosts)) + weights[-1]


def filtered(pages: DataFrame, rules: list[tuple[str, str]], weights: np.ndarray) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    sent = pages.sparkSession.sparkContext.broadcast(weights)  # 2 ** BITS numbers, whatever the input

    @F.pandas_udf("boolean")
    def blocked(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for host, path, asked in batches:
            out = np.zeros(len(host), bool)
            ends = np.cumsum(host.str.len().to_numpy() + path.str.len().to_numpy())
            rows = np.flatnonzero(asked.to_numpy(bool))
            # rows of about PIECE characters at a time, so that very long paths take no more memory together
            for part in np.split(rows, np.flatnonzero(np.diff(ends[rows] // PIECE)) + 1) if len(rows) else []:
                out[part] = score(sent.value, host.iloc[part].tolist(), path.iloc[part].tolist()) > 0
            yield pd.Series(out)

    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, action = matched_rule(F.col("host"), F.col("path"), rules)
    judged = split.withColumns({"rule": rule, "action": action})
    # rows that a rule decides, or without a host, are not scored
    judged = judged.withColumn("blocked", blocked("host", "path", F.col("action").isNull() & (F.col("host") != "")))
    verdict = F.coalesce("action", F.when(F.col("blocked"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES, train(url_table()))
