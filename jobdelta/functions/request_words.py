"""Words a job request is read with. All of them are fixed values; callers may pass tables of their own."""

# Counts written out, and currencies by sign or word.
COUNT_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
CURRENCIES = {"$": "USD", "£": "GBP", "€": "EUR", "usd": "USD", "dollars": "USD", "cad": "CAD", "aud": "AUD", "eur": "EUR",
              "euros": "EUR", "gbp": "GBP", "pounds": "GBP"}

# Metro areas by their names, and the towns each stands for.
METROS = [
    (["bay area", "sf bay area", "san francisco bay area"],
     ["bay area", "san francisco", "south san francisco", "oakland", "berkeley", "emeryville", "san jose", "palo alto",
      "mountain view", "sunnyvale", "menlo park", "redwood city", "san mateo", "santa clara", "cupertino", "foster city"]),
    (["greater austin", "austin area", "greater austin area", "austin metro", "austin metro area"],
     ["austin", "round rock", "cedar park", "pflugerville", "leander", "san marcos"]),
    (["nyc metro", "nyc metro area", "new york metro", "new york metro area", "new york area", "greater new york"],
     ["new york", "nyc", "brooklyn", "manhattan", "jersey city", "hoboken", "stamford", "white plains"]),
    (["greater seattle", "seattle area", "greater seattle area", "seattle metro", "puget sound"],
     ["seattle", "bellevue", "redmond", "kirkland", "bothell", "tacoma"]),
    (["greater boston", "boston area", "greater boston area", "boston metro"],
     ["boston", "cambridge", "somerville", "waltham", "woburn", "needham"]),
    (["greater los angeles", "la area", "los angeles area", "greater los angeles area", "socal"],
     ["los angeles", "santa monica", "culver city", "pasadena", "burbank", "irvine", "long beach", "el segundo", "playa vista"]),
    (["chicagoland", "chicago area", "greater chicago", "chicago metro"],
     ["chicago", "evanston", "schaumburg", "naperville", "oak brook"]),
    (["denver metro", "denver metro area", "denver area", "greater denver", "front range"],
     ["denver", "boulder", "broomfield"]),
]
# Other names of places.
ALIASES = {
    "nyc": ["new york", "nyc"],
    "new york city": ["new york", "nyc"],
    "sf": ["san francisco", "sf"],
    "silicon valley": ["san jose", "palo alto", "mountain view", "sunnyvale", "menlo park", "cupertino", "santa clara"],
    "la": ["los angeles"],
    "dc": ["washington"],
    "washington dc": ["washington"],
    "us": ["united states", "usa", "us"],
    "usa": ["united states", "usa", "us"],
    "united states": ["united states", "usa", "us"],
    "america": ["united states", "usa", "us"],
    "uk": ["united kingdom", "uk"],
    "united kingdom": ["united kingdom", "uk"],
}
# Names that narrow the city before them.
REGIONS = ["alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut", "delaware", "florida",
           "georgia", "hawaii", "idaho", "illinois", "indiana", "iowa", "kansas", "kentucky", "louisiana", "maine", "maryland",
           "massachusetts", "michigan", "minnesota", "mississippi", "missouri", "montana", "nebraska", "nevada", "ohio",
           "oklahoma", "oregon", "pennsylvania", "tennessee", "texas", "utah", "vermont", "virginia", "washington",
           "wisconsin", "wyoming", "usa", "us", "canada", "uk", "england", "germany", "france", "new hampshire", "new jersey",
           "new mexico", "new york", "north carolina", "north dakota", "rhode island", "south carolina", "south dakota",
           "west virginia", "united states", "united kingdom"]
STATE_CODES = ["al", "ak", "az", "ar", "ca", "co", "ct", "de", "fl", "ga", "hi", "id", "il", "in", "ia", "ks", "ky", "la",
               "me", "md", "ma", "mi", "mn", "ms", "mo", "mt", "ne", "nv", "nh", "nj", "nm", "ny", "nc", "nd", "oh", "ok",
               "or", "pa", "ri", "sc", "sd", "tn", "tx", "ut", "vt", "va", "wa", "wv", "wi", "wy", "dc"]

# Words that never name a role.
STOPWORDS = ["job", "jobs", "role", "roles", "position", "positions", "opening", "openings", "listing", "listings", "posting",
             "postings", "opportunity", "opportunities", "gig", "gigs", "work", "new", "newly", "all", "any", "every", "find",
             "show", "watch", "track", "monitor", "notify", "alert", "alerts", "me", "us", "my", "tell", "let", "know", "when",
             "whenever", "about", "for", "the", "a", "an", "with", "that", "which", "who", "are", "is", "be", "in", "at", "of",
             "and", "or", "to", "i", "we", "want", "wants", "looking", "look", "need", "needs", "get", "please", "company",
             "companies", "level", "levels", "experience", "experienced", "years", "year", "hiring", "there", "posted", "post",
             "open", "up", "comes", "come", "appears", "appear", "available", "full", "time", "fulltime", "full-time", "only",
             "just", "also", "some", "based", "located", "area", "anywhere", "everything", "regardless", "board", "boards",
             "it", "its", "this", "these", "those", "on", "by", "from", "like", "such", "as", "type", "types", "kind", "kinds",
             "hey", "hi", "hello", "use", "using", "via", "they", "them", "you", "your", "ones", "whatever", "check", "keep",
             "eye", "can", "could", "would", "will", "do", "does", "give", "list", "see", "what", "whats", "current",
             "currently", "right", "now", "today", "latest", "recent", "recently"]
# Role nouns that say little alone, and word endings that are not a plural.
GENERIC = ["engineer", "engineers", "engineering", "developer", "developers", "development", "dev", "devs", "programmer",
           "programmers", "software", "swe", "specialist", "professional"]
NOT_PLURAL = "ios|aws|kubernetes|devops|sales|analytics|operations|success|business|systems|rails|js"


def place_aliases() -> dict[str, list[str]]:
    """Every name of a place that stands for others, with the towns it stands for."""
    return {name: towns for names, towns in METROS for name in names} | ALIASES
