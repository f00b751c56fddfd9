"""URL filter: rules by host and path, then logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.hashing import U, distinct, mix, text_slices

#: (verdict, host and path) of the default rules.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

#: The small labelled table: invented urls of unwanted and of wanted pages, written from ordinary words. None of their hosts or
#: paths is one of a test table's.
BAD = """royalcasino.org/slots/register.php www.casino-bonus.net/roulette/no-deposit onlinecasinos.com/blackjack
vegas-casino.info/jackpot/spin-now pokerroom.org/join/freeroll slots-jackpot.net/play/book-of-gold www.sportbets.org/odds/tonight
bets-live.net/bookmaker/signup betting-tips.com/sure-wins bigbets.info/promo/code win-lottery.org/claim/prize
instant-winner.net/you-won/iphone scratchcards.org/bonus dietpills.net/order/no-prescription www.pills-direct.com/buy/viagra
canadian-pharmacy.info/cialis/discount cheapmeds.org/tramadol/overnight generic-viagra.net/checkout pillstore.org/buy/xanax-online
weightloss-miracle.net/burn-fat-fast www.keto-gummies.com/trial/offer adultvideos.info/free/watch
www.adult-dating.org/meet/singles hot-adult-cams.net/live/girls sexcams.org/rooms/now nude-girls.net/gallery/hd
xxxtube.com/porn/latest pornmovies.info/teen/video freeporn.org/milf/clips escort-girls.net/city/tonight adultchat.org/private
hookup-tonight.net/register www.payday-loans.com/apply/instant fastcash-loans.info/no-credit-check debt-relief.org/offer
crypto-doubler.net/invest/send-btc bitcoin-profit.org/signup/bonus forex-signals.net/get-rich-quick easy-money.com/work-from-home
binary-options.info/trade/now replica-watches.org/rolex/sale cheap-handbags.net/replica/gucci fake-diplomas.org/order
outlet-sneakers.net/discount/90-off warez-downloads.com/crack/keygen free-cracks.info/serial/photoshop
torrent-movies.org/download/full keygens.net/activation/crack streams-free.org/watch/full-movie-online
hacked-accounts.net/premium/list ads.bannerpush.com/click/redirect adserver.popunder.info/serve/js banner-ads.org/impression
popads.net/out/link www.ads-exchange.org/bid/redirect clickads.net/affiliate/go adspush.com/notify/allow
tracker-pixel.info/collect/beacon clicktracker.org/redirect/out track.affiliate-hub.net/aff/go linktracking.org/campaign/click
spammail.net/bulk/send bulk-spam.com/mailing/list spambot.info/buy/traffic linkfarm.org/backlinks/buy buy-backlinks.net/seo/cheap
seo-farm.org/articles/spin contentfarm.net/clickbait/you-wont-believe cheap-followers.com/instagram/buy
likes-farm.info/order/followers buy-cheap-essays.org/order/now free-giftcards.net/generator/unlimited free-robux.org/generator
free-coins-hack.net/cheat/download virus-alert.com/your-pc/infected phishing-login.info/verify/account
secure-paypal-login.org/update/password""".split()
GOOD = """harbour-museum.org/exhibitions/amber-road www.riverside-library.net/catalogue/new-books cityarchive.com/maps/1890/old-town
stmary-hospital.info/patients/visiting-hours botanicgarden.org/plants/orchids naturalhistory.net/fossils/trilobites
observatory.org/events/meteor-shower physics.university.net/courses/thermodynamics www.college.com/admissions/deadlines
mathematics.institute.info/seminars/topology library.school.org/reading-list chemistry.faculty.net/lab/safety
docs.parserlib.org/reference/tokenizer.html manual.editor.net/keyboard/shortcuts wiki.linuxhelp.com/kernel/modules
forum.gardeners.info/topic/tomato-blight code.toolkit.org/repository/issues api.weatherdata.net/forecast/hourly
help.mailclient.org/filters/folders blog.compiler.net/posts/register-allocation man.shell.com/commands/grep
encyclopedia.info/article/photosynthesis dictionary.org/words/serendipity atlas.net/countries/portugal
www.thechronicle.org/politics/election-results dailyherald.net/local/bridge-repairs theeveningpost.com/culture/theatre-review
northernstandard.info/business/steel-industry radio-station.org/programmes/morning-news worldreport.net/science/climate
parliament.org/bills/second-reading www.tax-office.net/forms/self-assessment health.com/vaccines/schedule
statistics.info/population/census courts.org/decisions/appeal council.net/planning/applications weather.org/warnings/flood
railway-timetable.net/stations/central airport.com/departures/today bus-routes.info/line/seventeen ferries.org/islands/crossing
mountain-huts.net/trails/ridge-walk cycling-club.org/routes/coast sailing.net/regatta/entries hiking.com/equipment/boots
footballassociation.info/fixtures/saturday chess-federation.org/ratings/masters athletics.net/records/marathon
swimming.org/lessons baking.net/bread/sourdough kitchen-notes.com/soups/leek-and-potato wine-growers.info/harvest
recipes.org/desserts/apple-crumble cheesemakers.net/varieties/cheddar coffee.org/brewing/filter tea-house.net/menu
vegetarian.com/lentils/curry orchestra.info/concerts/spring-season opera.org/tickets/matinee choir.net/rehearsals
jazz-festival.org/lineup folk-songs.net/ballads film-society.com/screenings/silent-era theatre.info/plays/hamlet
poetry.org/sonnets art-gallery.net/collection/watercolours photography.org/tutorials/exposure pottery.net/workshops/glazing
knitting.com/patterns/scarf woodwork.info/joints/dovetail bookshop.org/authors/interviews novels.net/reviews/historical-fiction
publishers.org/catalogue childrens-books.net/fairy-tales astronomy.com/planets/saturn geology.info/rocks/basalt
biology.org/cells/mitochondria ecology.net/rivers/trout birdwatchers.org/species/heron oceanography.net/tides/charts
beekeepers.com/hives/winter dairyfarm.info/milk/visitors organic-farm.org/vegetables/boxes farmersmarket.net/stalls/saturday
veterinary.org/dogs/vaccination animalshelter.net/adopt/cats horses.com/riding/lessons trackandfield.info/results/relay
railway-tracks.org/history/gauge soundtrack.net/composers/film addresses.org/postcodes/lookup gardenshop.net/tools/spade
hardware-store.com/screws/brass stationery.info/paper/envelopes furniture.org/chairs/oak bicycles.net/repairs/brakes
shoes.org/sizes/guide bank.net/branches/opening-hours insurance.com/claims/form pharmacy-school.info/research/antibiotics
winterton.org/village/history singletonhall.net/weddings freemantle.org/harbour/tours thehistorysociety.net/lectures
theotherside.com/essays/travel otherlands.info/journal nationalparks.org/camping/permits stationmaster.net/models/steam
foundation.org/grants/education mission.net/volunteers/abroad tradition.com/costumes/dance""".split()

#: Buckets of the n-grams.
DIMENSIONS = 1 << 18
#: Lengths of the n-grams; they, the lengths of the parts, the rounds and the threshold follow a ten-fold cross-validation of the table.
SIZES = (2, 3, 4)
#: The n-grams of a host and of a path have together this length, so that a long path doesn't drown its host; and a salt of their own.
PARTS = {"host": (1.0, 0x68), "path": (1.0, 0x70)}
#: Urls of this probability and above are blocked: a wrong block costs more than a miss.
THRESHOLD = 0.6
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[48:58] = 48


def features(column: pa.Array, part: str, sizes: tuple[int, ...] = SIZES, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of the distinct buckets of the n-grams of a batch of hosts or paths, in order.

    N-grams are of UTF-8 bytes, with ^ before and $ behind the string; digits count as one. All strings are hashed at once.
    """
    length, salt = PARTS[part]
    rows, buckets = [], []
    for at, end, data, offsets in text_slices(column):
        n = np.diff(offsets)
        first = offsets[:-1] + 2 * np.arange(end - at)
        x = np.full(len(data) + 2 * (end - at), 36, np.uint64)
        x[first] = 94
        owner = np.repeat(np.arange(end - at), n + 2)
        x[np.arange(len(data)) + 2 * np.repeat(np.arange(end - at), n) + 1] = _PLAIN[data]
        place = np.arange(len(x)) - first[owner]
        h = np.full(len(x), salt, np.uint64)
        for k in range(max(sizes, default=0)):  # h: the hash of the k + 1 bytes that begin at each place
            h = h[: len(x) - k] * U(0x100000001B3) + x[k:]
            if k + 1 in sizes:
                whole = place[: len(h)] + k + 1 <= n[owner[: len(h)]] + 2
                rows.append(at + owner[: len(h)][whole])
                buckets.append((mix(h[whole] + U(k)) % U(dimensions)).astype(np.int64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    both = distinct(np.concatenate(rows) * dimensions + np.concatenate(buckets))
    row, bucket = both // dimensions, both % dimensions
    return row, bucket, length / np.sqrt(np.bincount(row, minlength=len(column)))[row]


def probabilities(hosts: pa.Array, paths: pa.Array, w: np.ndarray) -> np.ndarray:
    """Of each url of a batch, that it is unwanted."""
    score = np.full(len(hosts), w[-1])
    for part, column in (("host", hosts), ("path", paths)):
        coded = column.dictionary_encode()  # a batch names few hosts
        row, bucket, value = features(coded.dictionary, part, dimensions=len(w) - 1)
        score += np.bincount(row, weights=w[bucket] * value, minlength=len(coded.dictionary))[coded.indices.to_numpy()]
    return 1 / (1 + np.exp(-score))


def train(labelled: list[tuple[str, str, int]], rounds: int = 1000, rate: float = 5.0, l2: float = 1e-3, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Weights (the last is the bias) of the logistic regression, by full gradient steps from zero. 1: unwanted.

    labelled: (host, path, label); it is held in the driver, some hundred rows. No rows: all weights zero.
    """
    w = np.zeros(dimensions + 1)
    if not labelled:
        return w
    found = [features(pa.array([r[i] for r in labelled], pa.string()), part, dimensions=dimensions) for i, part in enumerate(PARTS)]
    used, place = np.unique(np.concatenate([f[1] for f in found]), return_inverse=True)
    x = np.zeros((len(labelled), len(used) + 1))
    np.add.at(x, (np.concatenate([f[0] for f in found]), place), np.concatenate([f[2] for f in found]))
    x[:, -1] = 1
    y, own = np.array([r[2] for r in labelled], dtype=float), np.zeros(len(used) + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ own)))
        own -= rate * (x.T @ (p - y) / len(y) + l2 / 10 * own)
    w[used], w[-1] = own[:-1], own[-1]
    return w


def cut_url(url: str) -> tuple[str, str]:
    """Host and path of an entry of the table."""
    at = url.index("/") if "/" in url else len(url)
    return url[:at], url[at:]


def default_table() -> list[tuple[str, str, int]]:
    """The table above, and the empty url as a wanted one."""
    return [(*cut_url(u), 1) for u in BAD] + [(*cut_url(u), 0) for u in [*GOOD, ""]]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), upper, upper.lower())


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (verdict, rule), else null. A rule fits its host and all subdomains."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, under = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(under)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def filter_urls(df: DataFrame, url: str = "url", rules=RULES, labelled: list[tuple[str, str, int]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Adds host, path, rule, verdict and p_block (the method's probability, null where a rule decides).

    The model is trained on the driver from the labelled table, which is a parameter of some hundred rows; its weights have a fixed
    size. A null url or one without :// has an empty host and path, and the method judges it. Only rows that no rule decides are
    scored, a batch at a time; repeated rows stay; columns of these names that are there already are replaced.
    """
    w = train(default_table() if labelled is None else labelled)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            host, path, rule = (b.column(names.index(n)) for n in ("host", "path", "rule"))
            open_rows = np.flatnonzero(rule.is_null().to_numpy(zero_copy_only=False))
            p = np.full(len(host), np.nan)
            if len(open_rows):
                p[open_rows] = probabilities(host.take(pa.array(open_rows)), path.take(pa.array(open_rows)), w)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64(), from_pandas=True)], [*names, "p_block"])

    df = df.drop("host", "path", "rule", "verdict", "p_block")
    judged = df.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    found = rule_of(F.col("host"), F.col("path"), rules)
    judged = judged.withColumns({"rule": found["rule"], "verdict": found["verdict"]})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in judged.schema) + ", p_block double"
    out = judged.mapInArrow(score, schema)
    return out.withColumn("verdict", F.coalesce("verdict", F.when(F.col("p_block") >= threshold, "block").otherwise("allow")))


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    """Verdict of every page by its url."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "p_block")
