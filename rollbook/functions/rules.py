"""Word lists and thresholds of the record rules. All are fixed values that results depend on."""

# Names that are field labels, generic words, and phrases of navigation text.
LABEL_WORDS = [
    "phone", "email", "website", "fax", "address", "mailing address", "street address", "contact", "contact us", "hours", "services",
    "service area", "category", "specialty", "specialties", "type", "description", "about", "summary", "name", "title", "company",
    "tel", "telephone", "e-mail", "url", "web",
]
GENERIC_WORDS = [
    "member", "members", "vendor", "vendors", "supplier", "suppliers", "provider", "providers", "customer", "customers", "client", "clients",
    "partner", "partners", "user", "users", "account", "accounts", "profile", "profiles", "listing", "listings", "details", "detail", "information", "info",
]
FALSE_NAME_PHRASES = [
    "faq", "faqs", "laws & regulations", "laws and regulations", "guides for", "guide to", "ready to", "find your", "why use", "why choose",
    "click here", "learn more", "read more", "get started", "sign up", "log in", "login", "register now", "privacy policy", "terms of",
    "cookie", "cookies", "all rights reserved", "copyright",
]
FALSE_NAME_PREFIXES = ["cities in", "city in", "management in", "managers in", "hoa management", "property management", "search results for", "showing results", "page"]

# Last words of names in canonical form.
SUFFIXES = {"incorporated": "inc", "corporation": "corp", "company": "co", "limited": "ltd"}

# Thresholds.
SHARED_EMAIL_RECORDS, SHARED_EMAIL_SHARE = 5, 0.20
COUNT_GATE_RATIO, COUNT_GATE_CLAMP = 0.8, 10
NAME_ONLY_TRIGGER = 0.7
NULL_RATIO = 0.70
PER_DOMAIN, RESULTS_PER_QUERY = 2, 25

# State codes.
STATES = (
    "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC"
).split()

# Domains that are never a firm's own site or a directory; path prefixes and file endings of other pages.
SKIP_DOMAINS = [
    "duckduckgo.com", "google.com", "bing.com", "yahoo.com", "msn.com", "youtube.com", "facebook.com", "twitter.com", "x.com", "linkedin.com",
    "instagram.com", "tiktok.com", "pinterest.com", "reddit.com", "quora.com", "wikipedia.org", "wikimedia.org", "amazon.com", "ebay.com",
    "yelp.com", "tripadvisor.com", "angi.com", "angieslist.com", "thumbtack.com", "homeadvisor.com", "houzz.com", "manta.com", "bbb.org",
    "yellowpages.com", "yp.com", "mapquest.com", "leadiq.com", "leadiq.co", "zoominfo.com", "rocketreach.co", "apollo.io", "hunter.io",
    "datanyze.com", "lusha.com", "signalhire.com", "contactout.com", "getprospect.com", "snov.io", "seamless.ai", "wiza.co", "intellispect.co",
    "causeiq.com", "crunchbase.com", "pitchbook.com", "indeed.com", "glassdoor.com", "monster.com", "ziprecruiter.com", "zillow.com",
    "realtor.com", "redfin.com", "trulia.com", "nytimes.com", "washingtonpost.com", "forbes.com", "businessinsider.com", "bloomberg.com",
    "reuters.com", "cnn.com", "cnbc.com", "nbcnews.com", "abcnews.go.com", "cbsnews.com", "foxnews.com", "usatoday.com", "medium.com",
    "substack.com", "dev.to", "blogspot.com", "wordpress.com", "archive.org", "web.archive.org",
]
SKIP_PREFIXES = ["/blog/", "/blogs/", "/news/", "/article/", "/articles/", "/post/", "/posts/", "/story/", "/stories/", "/forum/", "/forums/", "/discussion/", "/discussions/", "/thread/"]
SKIP_ENDINGS = [".pdf", ".doc", ".docx", ".xls", ".xlsx", ".csv", ".zip", ".rar", ".7z"]

# Words without weight in names, words of many trades, mail hosts of private persons.
BUSINESS_SUFFIXES = [
    "the", "and", "of", "for", "inc", "llc", "ltd", "corp", "co", "company", "corporation", "incorporated", "limited", "enterprises", "holdings",
    "associates", "international", "partners", "consulting", "group", "pllc", "lp", "pc", "pa", "dba",
]
INDUSTRY_WORDS = [
    "construction", "building", "builders", "electric", "electrical", "plumbing", "roofing", "painting", "heating", "cooling", "hvac", "landscaping",
    "cleaning", "concrete", "drywall", "flooring", "remodeling", "renovation", "restoration", "demolition", "excavating", "contracting", "contractor",
    "services", "solutions", "supply", "industries", "industrial", "mechanical", "environmental", "design", "designs", "homes", "home", "house",
    "properties", "real", "estate", "realty", "mortgage", "insurance", "financial", "management", "development", "systems", "technology",
    "technologies", "engineering", "fabrication", "fabricators", "manufacturing", "cabinets", "cabinetry", "windows", "doors", "fencing", "paving",
    "welding", "steel", "iron", "wood", "lumber", "pest", "defense", "quality", "custom", "premier", "advanced", "national", "american", "western",
    "eastern", "northern", "southern", "pro", "plus", "first", "best", "elite", "superior", "precision",
]
FREE_MAIL = [
    "gmail.com", "googlemail.com", "yahoo.com", "ymail.com", "rocketmail.com", "hotmail.com", "outlook.com", "live.com", "msn.com", "aol.com",
    "aim.com", "icloud.com", "me.com", "mac.com", "protonmail.com", "proton.me", "gmx.com", "gmx.us", "mail.com", "zoho.com", "yandex.com",
    "fastmail.com", "hey.com", "tutanota.com", "comcast.net", "verizon.net", "att.net", "sbcglobal.net", "cox.net", "bellsouth.net", "charter.net",
    "earthlink.net", "juno.com", "netzero.net", "frontier.com", "windstream.net", "centurylink.net", "optimum.net", "rr.com", "roadrunner.com",
    "twc.com", "example.com", "example.org", "test.com",
]

# Ranks of mail prefixes by how well they reach a firm.
EMAIL_TIERS = {0: ["info", "contact", "hello", "inquiries", "inquiry"], 1: ["office", "sales", "general"], 2: ["admin", "support", "help"]}
EMAIL_LOW = ["webmaster", "jobs", "careers", "recruiting", "hr", "billing", "invoices", "payments", "marketing", "newsletter", "news", "alerts", "feedback"]
EMAIL_JUNK = ["noreply", "no-reply", "donotreply", "do-not-reply", "mailer-daemon", "postmaster", "root", "unsubscribe", "bounce"]

# Categories of log messages by words in them, in order.
LOG_CATEGORIES = [
    ("NAV", ["navigat", "directory url", "depth ", "ai says", "ai wants"]),
    ("SEARCH", ["search", "trigger", "query", "trying '", "blank", "form-based", "view all", "starts with", "alphabet"]),
    ("SCROLL", ["scroll", "batch"]),
    ("PAGE", ["pagination", "page ", "load more", "categor"]),
    ("CAPTURE", ["response:", "captured", "total results"]),
    ("IFRAME", ["iframe"]),
    ("PARSE", ["pars", "extract", "selector", "sample:", "regex", "haiku", "member list", "member record", "schema.org"]),
    ("DETAIL", ["detail", "crawl", "phase ", "api endpoint", "api fast"]),
    ("CLEAN", ["clean", "dedup", "structured", "saved ", "saving"]),
]

# JSON keys by field, in order of preference.
FIELD_ALIASES = {
    "company_name": ["name", "companyname", "company_name", "businessname", "organizationname", "title", "nam", "displayname", "providername", "practicename", "firmname", "restaurantname", "doctorname", "attorneyname", "officename", "fullname", "entityname", "full_name"],
    "description": ["description", "about", "bio", "summary", "cnm", "overview", "details"],
    "category": ["specialties", "category", "type", "classification", "industry", "specialty", "cuisine", "cuisinetype", "practicearea", "discipline", "department", "servicearea", "services"],
    "website": ["website", "url", "web", "homepage", "personalwebsite", "personal_website", "personalurl"],
    "phone": ["mainphone", "phone", "phonenumber", "telephone", "tel"],
    "fax": ["fax", "faxnumber", "fax_number"],
    "street_address": ["address", "streetaddress", "street_address", "address1", "addressline1", "shippingaddress1", "ad1"],
    "mailing_address": ["mailingaddress", "mailing_address", "address2", "ad2"],
}
NAME_KEYS = ["name", "companyname", "company_name", "businessname", "organizationname", "title", "nam", "displayname", "providername", "practicename", "firmname", "restaurantname", "doctorname", "fullname", "full_name", "entityname", "officename", "attorneyname"]

# Words that speak for or against a group of detail pages.
DETAIL_WORDS = [
    "member", "profile", "company", "detail", "listing", "vendor", "supplier", "directory", "contact", "business", "organization", "firm", "provider",
    "doctor", "physician", "dentist", "attorney", "lawyer", "restaurant", "clinic", "specialist", "consultant", "therapist",
]
OTHER_PAGE_WORDS = [
    "blog", "news", "article", "post", "press", "event", "class", "course", "training", "workshop", "seminar", "webinar", "calendar", "schedule",
    "job", "career", "faq", "help", "support", "about", "team", "staff", "board", "committee", "gallery", "photo", "video", "podcast", "product",
    "shop", "store", "cart", "page", "tag", "archive",
]
