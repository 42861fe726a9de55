"""Inputs with known outcomes: facts about names, dates and headlines that the parsers must get right."""

REGISTRY = (  # company, registered name, collisions, outcome
    ("Quillfern", "QUILLFERN SINGAPORE PTE. LTD.", 1, "confirmed"),
    ("Quillfern", "QUILLFERN ASIA PACIFIC PTE. LTD.", 1, "confirmed"),
    ("Marrowind Systems", "MARROWIND PTE. LTD.", 2, "confirmed"),
    ("Marrowind Systems", "MARROWIND DATA PTE. LTD.", 1, "confirmed"),
    ("Ostrel AI", "OSTREL AI (SG) PTE. LTD.", 1, "confirmed"),
    ("Seven Labs", "SEVEN SEAS PTE. LTD.", 14, None),
    ("Tern", "TERN CONSULTING PTE. LTD.", 9, None),
    ("Tern", "TERN PTE LTD", 9, "probable"),
)
EVENT_DATES = (  # text, starts on, ends on
    ("SEMICON West 2026 · July 7–9, 2026 · Phoenix, AZ", "2026-07-07", "2026-07-09"),
    ("Automate 2026 | June 8-11, 2026 | Detroit, MI", "2026-06-08", "2026-06-11"),
    ("June 30 – July 2, 2026", "2026-06-30", "2026-07-02"),
    ("December 29 – January 3, 2026", "2026-12-29", "2027-01-03"),
    ("Asia Tech x Singapore — 26 - 28 May 2027 | Singapore", "2027-05-26", "2027-05-28"),
    ("7–9 July 2026", "2026-07-07", "2026-07-09"),
    ("30 June – 2 July 2026", "2026-06-30", "2026-07-02"),
    ("29 December – 3 January 2027", "2026-12-29", "2027-01-03"),
    ("12 May 2026, Marina Bay Sands", "2026-05-12", "2026-05-12"),
    ("Registration opens May 12, 2026", "2026-05-12", "2026-05-12"),
    ("Feb. 10–14, 2026", "2026-02-10", "2026-02-14"),
    ("Exhibitor Directory A–Z", None, None),
    ("© 2026 Semiconductor Equipment", None, None),
)
FUNDRAISES = (  # headline, round, amount, valuation
    ("Etched Raises $700M at $21B Valuation", None, 700e6, 21e9),
    ("Hadrian Raises $1.37B Series D, Valuing the Company at $7.87B", "series_d", 1.37e9, 7.87e9),
    ("Neros Raises $250M At $2.5B", None, 250e6, 2.5e9),
    ("Residents raise concerns over new $40M plant", None, None, None),
    ("Acme closes $12 million seed round", "seed", 12e6, None),
    ("Beta files for IPO", "ipo", None, None),
    ("Charity fundraiser nets $5,000", None, None, None),
    ("Gamma lands US$30m in Series B extension", "series_b_ext", 30e6, None),
    ("Delta opens an office", None, None, None),
)
PROFILES = (  # company website, headline, profile url, country, rounds in millions, outcome
    (None, "Acme raises $20.8M", None, None, [20.799999, 2.5], "round"),
    (None, "Acme raises $20.8M", None, "Germany", [], None),
    (None, "Beta secures €4.3M", None, None, [5.0, 0.78], "round"),
    (None, "Swiss startup opens a lab", None, "Switzerland", [], "country"),
    ("https://www.foo.com/about", "Foo raises a round", "foo.com", None, [], "website"),
    ("https://fo.ai", "Foo raises a round", "https://fo.com", None, [], None),
)
ROUNDS = (
    ("Series B - II", "series_b"), ("Seed VC", "seed"), ("Pre-Seed", "seed"), ("Growth Equity", None), ("Secondary Market", None),
    ("Convertible Note - III", None), ("IPO - II", "ipo"), ("Series L", "series_l"), ("Angel", None),
)
NAMES = (  # raw name, as compared
    ("Daré Technologies, Inc.", "dare"), ("D-Matrix Corp", "d matrix"), ("Smith & Sons Holdings Group", "smith and sons"), ("Labs", "labs"),
    ("  Société Générale  ", "societe generale"), ("Inc", "inc"), ("???", "???"),
)
URLS = (  # address, canonical form
    ("http://www.Example.com:80/a?utm_source=x&b=2&a=1#top", "https://example.com/a?a=1&b=2"),
    ("https://example.com/", "https://example.com"), ("ftp://example.com/x", None), ("not a url", None), ("HTTPS://Sub.Example.com", "https://sub.example.com"),
    ("https://example.com/?ref=y", "https://example.com"), ("https://example.com/p?b=1&b=0&gclid=3", "https://example.com/p?b=1&b=0"),
)
