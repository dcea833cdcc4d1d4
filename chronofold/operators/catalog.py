"""Infobox types: finding them, sorting them into categories, counting them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chronofold.functions.text import EDGE_L, EDGE_R, WS, sub, trim_all
from chronofold.schema import CATEGORIES

# Infobox types taken in when no catalog says otherwise.
DEFAULT_TYPES = [
    "event", "historical_event", "military_conflict", "war", "battle",
    "person", "biography", "officeholder", "royalty", "scientist", "military_person", "writer",
    "philosopher", "artist",
    "settlement", "country", "historical_country", "empire", "ancient_site", "archaeological_site",
    "invention", "ship"]

# Words that put an infobox type into a category.  Categories are
# tried in this order.  A word ending in * is a prefix, one starting with = is
# the whole type; "word unless a, b" needs the word and none of the others.
CATEGORY_WORDS = {
    "person": """
        person, biograph*, officehold*, scientist, actor, actress, artist, sportsperson, athlete, cricketer,
        cyclist, swimmer, boxer, golfer, gymnast, skier, figure skat*, dancer, wrestler, sumo, sailor, climber,
        surfer, equestrian, racing driver, aviator, astronaut, nascar driver, f1 driver, judoka, fencer,
        chess player, go player, snooker player, darts player, pool player, squash player, badminton player,
        volleyball player, biathlete, field hockey player, speedway rider, motorcycle rider, writer,
        philosopher, poet, composer, architect, historian, theologian, scholar, academic, economist, author,
        journalist, chef, engineer, noble, saint, monarch, royalty, physician, doctor, pharaoh, king, emperor,
        pope, bishop, patriarch, clergy, monk, rebbe, president, governor, mayor, judge, soldier,
        military personnel, pilot, police officer, comedian, model, serial killer, murderer, criminal, spy,
        pirate, bodybuilder, youtuber, social media personality, influencer, streamer, politician, diplomat,
        ambassador, minister, christian leader, jewish leader, hindu leader, muslim leader, ice hockey player,
        cfl player, nfl player, mlb player, npb player, gaelic games player,
        gaelic athletic association player, gaa player, college coach, college football player,
        pro gaming player, esports player, video game player, pageant titleholder, playboy playmate,
        lacrosse player, footballer, soccer player, mathemat*, chemist, physicist, presenter, musician""",
    "person unless": ["royal unless royal house, royal styles, royal family"],
    "historical_period": "historical era, historical period, historical continent, geologic timespan, dynasty",
    "concepts": """
        =technology, =invention, religion, christian denomination, christian branch, religious group, language,
        writing system, file format, networking protocol, algorithm, encryption, cryptograph*, music genre,
        art movement, cultural movement, =martial art""",
    "event": """
        aircraft occurrence, aircraft accident, ailiner accident, rail accident, public transit accident,
        plane crash, nuclear weapons test, holocaust event, conflict, battle, siege, election, referendum,
        disaster, earthquake, storm, hurricane, flood, tornado, epidemic, pandemic, outbreak, wildfire,
        eruption, famine, terrorist attack, civilian attack, assassination, coup, rebellion, protest,
        weather event, tropical cyclone, windstorm, military operation, military attack, cyberattack,
        oil spill, news event, summit meeting, historical event, =event""",
    "event unless": ["war unless war faction"],
    "business": """
        company, corporat*, airline, publisher, restaurant, hotel, casino, newspaper, record label, brewery,
        winery, law firm, dot-com""",
    "artifact": """
        ship, vessel, sailboat, aircraft, automobile, locomotiv*, motorcycle, spacecraft, weapon, firearm, album,
        musical composition, video game, artwork, artefact, artifact, painting, sculpture, short story,
        graphic novel, novella, comic book, comic strip, manga, manhwa, opera, ballet, =musical, camera,
        telescope, radar, coin, banknote, postage stamp, aero engine, mobile phone, smartphone,
        information appliance, synthesizer, musical instrument, =play""",
    "artifact unless": [
        "train unless train station", "rocket unless rocket launch, rocket engine",
        "film unless film festival, film award, film movement, film or theatre",
        "television unless television station, television channel", "song unless song contest",
        "software unless software licen*", "book unless book series", "novel unless novel series",
        "computer unless computer virus, computer worm"],
    "pol_mil_organization": """
        country, empire, political party, military unit, war faction, national military, law enforcement,
        government, militant organ*, geopolitical organ*, legislature, parliament, constituency,
        diplomatic mission, first nation, tribe, clan, royal house, organization, organisation, united nations,
        intergovernmental organ*, former subdivision""",
    "place": """
        settlement, city, town, village, commune, municip*, building, archaeolog*, river, mountain, lake, park,
        protected area, nrhp, hospital, prison, airport, church, monastery, temple, mosque, shrine, school,
        university, college, museum, library, bridge, dam, tunnel, canal, lighthouse, venue, stadium, cemetery,
        military installation, island, body of water, landform, glacier, waterfall, port, castle, uk place,
        turkey place, australian place, german loc*, german place, italian comune, russian inhabit*,
        russian district, valley, bay, cape, beach, cave, waterway, wine region, station, road, shopping mall,
        zoo, site""",
    "place unless": ["mine unless mineral"],
}


def _words(listing: str) -> str:
    out = []
    for w in (w.strip() for w in listing.split(",")):
        if w.startswith("="):
            out.append(rf"^{w[1:]}\z")
        elif w.endswith("*"):
            out.append(EDGE_L + w[:-1])
        else:
            out.append(EDGE_L + w + EDGE_R)
    return "|".join(" ".join(w.split()) for w in out)


def category_of(infobox_type: Column) -> Column:
    """Category of an infobox type; 'other' when no word fits."""
    t = F.replace(F.lower(infobox_type), F.lit("_"), F.lit(" "))
    has = lambda listing: F.regexp_like(t, F.lit(_words(listing)))
    out = None
    for name, listing in CATEGORY_WORDS.items():
        if name.endswith(" unless"):
            continue
        hit = has(listing)
        for rule in CATEGORY_WORDS.get(f"{name} unless", []):
            word, others = rule.split(" unless ")
            hit = hit | (has(word) & ~has(others))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def infobox_types(wikitext: Column) -> Column:
    """Every infobox type of a page in order, repeats kept."""
    names = F.regexp_extract_all(wikitext, F.lit(rf"\{{\{{{WS}*[Ii]nfobox{WS}+([^\n|}}<>{{\[\]]+)"), F.lit(1))
    return F.transform(names, lambda n: sub(F.lower(trim_all(n)), f"{WS}+", "_"))


def primary_type(types: Column, include: list[str]) -> Column:
    return F.get(F.filter(types, lambda t: t.isin(*include)), F.lit(0))


def roll_up(pages: DataFrame, include: list[str]) -> DataFrame:
    """Count per infobox type, whether any page with it was taken in, and
    whether the given set names it."""
    typed = pages.select(infobox_types(F.col("wikitext")).alias("types"))
    t = typed.select(F.explode("types").alias("infobox_type"),
                     F.exists("types", lambda x: x.isin(*include)).alias("included"))
    n = t.groupBy("infobox_type").agg(F.count(F.lit(1)).alias("count"), F.max("included").alias("was_included"))
    return n.select("infobox_type", category_of(F.col("infobox_type")).alias("proposed_category"), "count",
                    "was_included", F.col("infobox_type").isin(*include).alias("include_in_future"))


def recategorise(catalog: DataFrame) -> DataFrame:
    return catalog.withColumn("proposed_category", category_of(F.col("infobox_type")))


def category_counts(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("proposed_category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "proposed_category")


def ingest_counts(judged: DataFrame) -> DataFrame:
    """Considered, collected and rejected pages per category, all nine listed."""
    kept = F.col("reject_reason").isNull().cast("long")
    n = judged.groupBy("category").agg(F.count(F.lit(1)).alias("considered"), F.sum(kept).alias("collected"),
                                       F.sum(1 - kept).alias("rejected"))
    all_nine = judged.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    return F.broadcast(all_nine).join(n, "category", "left").na.fill(0)


# Markup that hints at coordinates, for the report.
SIGNALS = {
    "coord-template": r"\{\{\s*coord",
    "location-map": r"\{\{\s*location\s*map",
    "latd/longd": r"\|\s*lat[_ ]?d\s*=|\|\s*long?[_ ]?d\s*=",
    "lat_deg/lon_deg": r"\|\s*lat_?deg\s*=|\|\s*lo(?:n|ng)_?deg\s*=",
    "latitude/longitude": r"\|\s*latitude\s*=|\|\s*longitude\s*=",
    "lat/long-plain": r"\|\s*lat\s*=\s*-?[\d.]|\|\s*long?\s*=\s*-?[\d.]",
    "coordinates-field": r"\|\s*coordinates\s*=",
    "map-image/svg": r"\|\s*(?:image[_ ]?map|map[_ ]?image|map)\s*=.*\.svg",
    "geo-microformat": r"\{\{\s*geo|class\s*=\s*\"geo\"",
}


def signal_tally(pages: DataFrame) -> DataFrame:
    """Pages per coordinate signal, with NONE and what is already extracted.

    pages: (wikitext, has_points).
    """
    flags = [F.regexp_like("wikitext", F.lit("(?i)" + p.replace(r"\s", WS))).cast("int").alias(n) for n, p in SIGNALS.items()]
    df = pages.select("has_points", *flags)
    any_hit = F.greatest(*[F.col(f"`{n}`") for n in SIGNALS])
    sums = df.agg(F.count(F.lit(1)).alias("n_pages"), *[F.coalesce(F.sum(f"`{n}`"), F.lit(0)).alias(n) for n in SIGNALS],
                  F.coalesce(F.sum(1 - any_hit), F.lit(0)).alias("NONE"),
                  F.coalesce(F.sum(F.col("has_points").cast("int")), F.lit(0)).alias("extracted-now"))
    rows = F.array(*[F.struct(F.lit(n).alias("signal"), F.col(f"`{n}`").alias("n")) for n in [*SIGNALS, "NONE", "extracted-now"]])
    return sums.select(F.explode(rows).alias("r"), "n_pages").select("r.signal", "r.n", F.when(
        F.col("n_pages") > 0, F.col("r.n") * 100 / F.col("n_pages")).alias("percent"))
