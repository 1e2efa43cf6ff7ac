"""Fixed values.

Every list here is a value the results depend on (word lists, lookup tables,
thresholds). They are plain data, kept in the order in which the rules apply
them, because several rules report the *first* entry that matches.
"""

from __future__ import annotations


def _words(text: str) -> list[str]:
    return text.split()


# --- fixed values: public suffixes with more than one label -----------------
TWO_PART_SUFFIXES = _words("""
co.uk ac.uk gov.uk org.uk me.uk net.uk sch.uk
co.in net.in org.in gov.in ac.in nic.in firm.in gen.in ind.in
com.au net.au org.au edu.au gov.au
com.br net.br org.br gov.br edu.br
co.jp or.jp ne.jp go.jp ac.jp ad.jp
com.cn net.cn org.cn gov.cn edu.cn ac.cn
co.kr or.kr ne.kr go.kr re.kr ac.kr
co.za org.za net.za gov.za ac.za
com.mx net.mx org.mx gob.mx edu.mx
com.tr net.tr org.tr gov.tr edu.tr
com.sg net.sg org.sg gov.sg edu.sg
com.hk net.hk org.hk gov.hk edu.hk
com.tw net.tw org.tw gov.tw edu.tw
com.ar net.ar org.ar gob.ar edu.ar
com.my net.my org.my gov.my edu.my
co.id or.id ne.id go.id ac.id web.id
com.ph net.ph org.ph gov.ph edu.ph
com.vn net.vn org.vn gov.vn edu.vn
com.pk net.pk org.pk gov.pk edu.pk
com.bd net.bd org.bd gov.bd edu.bd
com.sa net.sa org.sa gov.sa edu.sa
com.eg net.eg org.eg gov.eg edu.eg
com.ng net.ng org.ng gov.ng edu.ng
com.ke net.ke org.ke go.ke ac.ke
com.ua net.ua org.ua gov.ua edu.ua
com.pl net.pl org.pl gov.pl edu.pl
com.ru net.ru org.ru msk.ru spb.ru
com.es net.es org.es gob.es edu.es
com.it net.it org.it gov.it edu.it
com.fr net.fr org.fr gouv.fr
com.de net.de org.de gov.de edu.de
""")
THREE_PART_SUFFIXES = ["co.uk.com", "com.br.com"]

# --- fixed values: default ports ---------------------------------------------
DEFAULT_PORTS = {"http": 80, "https": 443, "ftp": 21, "sftp": 22, "ws": 80, "wss": 443}
FEATURE_DEFAULT_PORTS = {"http": 80, "https": 443, "ftp": 21, "ws": 80, "wss": 443}
RULE_DEFAULT_PORTS = {"http": 80, "https": 443}

# --- fixed values: lexical features ------------------------------------------
SUSPICIOUS_TLDS = _words("""
tk ml ga cf gq xyz top work date click icu cfd gdn bond cyou sbs hair monster lol pics
download review country stream loan win racing accountant science party webcam bid trade
cricket men
""")
FEATURE_KEYWORDS = _words("""
login signin verify secure account update confirm banking password credential paypal
billing support alert recovery unlock validate
""")
FEATURE_EXTENSIONS = _words(
    ".exe .bat .cmd .msi .scr .js .vbs .ps1 .jar .apk .dmg .deb .rpm .hta")
SPECIAL_CHARS = "!@#$%^&*()_+-=[]{}|;:,.<>?/~`"

# --- fixed values: rule engine ------------------------------------------------
TRUSTED_DOMAINS = _words("""
google.com google.co.in google.co.uk bing.com yahoo.com duckduckgo.com baidu.com yandex.com
youtube.com youtu.be facebook.com fb.com instagram.com twitter.com x.com linkedin.com
reddit.com pinterest.com tumblr.com snapchat.com tiktok.com discord.com telegram.org
whatsapp.com
netflix.com spotify.com twitch.tv vimeo.com hulu.com disneyplus.com primevideo.com hbomax.com
github.com gitlab.com bitbucket.org stackoverflow.com stackexchange.com npmjs.com pypi.org
docker.com kubernetes.io terraform.io ansible.com
aws.amazon.com cloud.google.com azure.microsoft.com digitalocean.com heroku.com vercel.com
netlify.com cloudflare.com fastly.com akamai.com
amazon.com amazon.in amazon.co.uk ebay.com etsy.com shopify.com walmart.com target.com
bestbuy.com aliexpress.com flipkart.com
bbc.com bbc.co.uk cnn.com nytimes.com wsj.com theguardian.com reuters.com bloomberg.com
forbes.com techcrunch.com theverge.com wired.com arstechnica.com
wikipedia.org wikimedia.org wiktionary.org coursera.org udemy.com edx.org khanacademy.org
udacity.com pluralsight.com skillshare.com docs.python.org python.org w3schools.com
mozilla.org developer.mozilla.org geeksforgeeks.org tutorialspoint.com
docs.google.com sheets.google.com slides.google.com drive.google.com calendar.google.com
meet.google.com notion.so trello.com asana.com slack.com zoom.us teams.microsoft.com
webex.com skype.com
microsoft.com office.com live.com outlook.com apple.com icloud.com mac.com
medium.com dev.to hashnode.com substack.com wordpress.com wordpress.org blogger.com wix.com
godaddy.com namecheap.com
paypal.com stripe.com square.com venmo.com dropbox.com box.com onedrive.com wetransfer.com
""")
SAFE_TLD_SUFFIXES = [".gov", ".edu", ".mil", ".ac.uk", ".gov.in", ".nic.in"]
HIGH_RISK_TLDS = ["." + t for t in SUSPICIOUS_TLDS]
RULE_BRANDS = _words("""
paypal google facebook apple amazon microsoft netflix instagram whatsapp twitter linkedin
dropbox spotify discord steam github gitlab binance coinbase metamask trustwallet blockchain
bank credit loan mortgage irs tax dhl fedex ups usps westernunion moneygram
norton mcafee avg avast kaspersky bitdefender zoom skype telegram signal viber
wordpress shopify wix squarespace weebly roblox fortnite minecraft epicgames origin
tinder bumble hinge grindr uber lyft doordash airbnb booking crypto nft defi web3 dao
""")
OFFICIAL_SUFFIXES = ["com", "org", "net", "co", "io", "in"]
RULE_KEYWORDS = _words("""
login signin logon authenticate authorize verify confirm validate activate
password passwd pwd credential secret account profile dashboard admin administrator
recover reset unlock restore change-password
paypal banking payment checkout billing invoice wallet deposit withdraw transfer transaction
credit debit balance statement tax refund irs
security alert warning suspended limited blocked urgent immediate attention important critical
unauthorized suspicious compromised breach hacked
won winner prize reward bonus free gift claim congratulations selected chosen lucky
exclusive limited-time expires hurry act-now
cmd config backup root exec script token api oauth callback redirect webscr
tracking shipment delivery parcel package courier customs duty clearance dispatch arrival
""")
RULE_EXTENSIONS = _words("""
.exe .bat .cmd .msi .scr .ps1 .vbs .vbe .js .jse .wsf .wsh .jar .apk .dmg .pkg .deb .rpm
.hta .cpl .msc .reg .lnk .url
""")
DANGEROUS_SCHEMES = ["data:", "javascript:", "vbscript:", "file:"]
SENSITIVE_WORDS = _words("""
login signin password account banking payment checkout verify credit billing auth token
secret credential
""")
ADMIN_PATHS = _words("""
/wp-admin /wp-content /wp-includes /administrator /phpmyadmin /cpanel /webmail /.env /config.php
""")
PHISHING_PATHS = _words("""
/login.php /signin.php /verify.php /account.php /update.php /confirm.php /secure/ /auth/
/api/v1/auth /oauth/callback /password-reset
""")
REDIRECT_PARAMS = ["redirect", "url=", "return=", "next=", "goto=", "target=", "redir="]

# --- fixed values: quick checks on live flows ---------------------------------
LIVE_TLDS = _words(".tk .ml .ga .cf .gq .xyz .top .work .click .icu .cfd")
LIVE_KEYWORDS = _words(
    "login verify paypal banking password account confirm secure signin")
TRAFFIC_TLDS = _words(".tk .ml .ga .cf .gq .xyz .top .work")
TRAFFIC_KEYWORDS = _words("login verify paypal banking password account")
SUSPICIOUS_PORTS = [22, 23, 445, 3389, 8080]

# --- fixed values: brand dictionary -------------------------------------------
BRANDS = _words("""
google microsoft apple amazon facebook meta paypal netflix instagram whatsapp twitter
linkedin youtube tiktok snapchat pinterest reddit discord telegram signal spotify dropbox
github gitlab bitbucket stackoverflow adobe oracle salesforce sap ibm intel nvidia amd cisco
dell hp lenovo samsung sony lg huawei xiaomi nokia ericsson verizon att comcast
chase wellsfargo bankofamerica citibank hsbc barclays santander capitalone americanexpress
discover mastercard visa stripe square venmo cashapp zelle binance coinbase kraken metamask
trustwallet blockchain bitcoin ethereum coinmarketcap
walmart target costco homedepot lowes bestbuy ikea ebay etsy alibaba aliexpress flipkart
shopify wish dhl fedex ups usps royalmail dpd hermes irctc indigo airindia emirates delta
united american-airlines booking airbnb expedia tripadvisor uber lyft ola doordash ubereats
zomato swiggy zoom slack teams webex skype notion trello asana monday figma canva atlassian
jira confluence steam epicgames roblox minecraft playstation xbox nintendo ea ubisoft
activision riotgames bbc cnn nytimes wsj washingtonpost theguardian reuters bloomberg forbes
paytm phonepe gpay razorpay icicibank hdfcbank sbicard axisbank kotakbank yesbank airtel jio
vi bsnl actfibernet irctc uidai incometax gst nsdl cdsl sebi
""")
HIGH_VALUE_BRANDS = _words("""
paypal microsoft apple google amazon facebook netflix chase wellsfargo bankofamerica citibank
hsbc binance coinbase metamask
""")
SIMILARITY_THRESHOLD = 0.75
LENGTH_TOLERANCE = 3
TECHNIQUE_BOOST = {
    "character_substitution": 10, "homoglyph": 20, "punycode": 25, "combosquatting": 5,
    "insertion": 5, "deletion": 5, "transposition": 8, "vowel_swap": 8, "edit_distance": 0,
}
# look-alike characters and the Latin text they stand for
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "к": "k", "м": "m",
    "т": "t", "н": "h", "в": "b", "і": "i", "ј": "j", "ѕ": "s", "г": "r", "п": "n", "л": "l",
    "д": "d", "ф": "f", "ц": "c", "ч": "ch", "ш": "w", "щ": "w", "ъ": "b", "ы": "y", "ь": "b",
    "э": "e", "ю": "yu", "я": "ya",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    # full-width Latin a-z
    **{chr(0xFF41 + i): chr(0x61 + i) for i in range(26)},
}

# --- fixed values: risk fusion -------------------------------------------------
SIGNALS = ["rule_score", "ml_score", "ip_score", "domain_score", "threat_score"]
RISK_WEIGHTS = {
    "rule_score": 0.25, "ml_score": 0.35, "ip_score": 0.20, "domain_score": 0.10,
    "threat_score": 0.10,
}
RISK_THRESHOLDS = {"benign": 30, "suspicious": 60, "high_risk": 80}

# --- fixed values: destination policy -----------------------------------------
METADATA_IPS = ["169.254.169.254", "fd00:ec2::254", "100.100.100.200"]
BLOCKED_HOSTS = ["localhost", "localhost.localdomain", "metadata.google.internal", "metadata",
                 "instance-data"]
ALLOWED_SCHEMES = ["http", "https"]
BLOCKED_SUFFIXES = [".local", ".internal", ".localhost", ".test", ".example"]
MAX_URL_LENGTH = 4096
MAX_REDIRECTS = 5

# --- fixed values: IP intelligence ----------------------------------------------
HOSTING_ASNS = _words("""
AS16509 AS14618 AS14061 AS63949 AS20473 AS16276 AS24940 AS12876 AS60781 AS9009 AS4766
AS45102 AS132203 AS8075 AS15169 AS396982 AS13335
""")
VPN_ASNS = _words("AS9009 AS212238 AS62240 AS49981 AS60068")
TOR_PREFIXES = _words("""
185.220. 51.15. 51.75. 51.77. 51.89. 176.10. 176.126. 199.249. 204.13. 171.25. 46.165.
""")
HIGH_RISK_COUNTRIES = _words("KP IR SY SD CU VE RU BY MM")
MEDIUM_RISK_COUNTRIES = _words("CN NG PK BD VN ID UA TR")
GEO_FLAG_COUNTRIES = _words("KP IR SY SD CU VE RU CN BY MM")
COMBINED_RISK_WEIGHTS = {"abuse": 0.35, "internal": 0.20, "asn": 0.15, "country": 0.10,
                         "threats": 0.10, "alerts": 0.10}

# --- fixed values: WHOIS ----------------------------------------------------------
PRIVACY_REGISTRARS = _words("""
namecheap godaddy namesilo cloudflare tucows enom publicdomainregistry privacy whoisguard
domainsbyproxy
""")
FREE_TLDS = [".tk", ".ml", ".ga", ".cf", ".gq"]

# --- fixed values: mail and name-server providers (first match wins) ---------------
MAIL_PROVIDERS = [
    ("Google", ["google", "googlemail"]), ("Microsoft", ["outlook", "microsoft"]),
    ("Zoho", ["zoho"]), ("Yandex", ["yandex"]), ("ProtonMail", ["protonmail", "proton"]),
    ("Cloudflare", ["cloudflare"]),
]
NS_PROVIDERS = [
    ("Cloudflare", ["cloudflare"]), ("AWS Route53", ["awsdns"]),
    ("Google Cloud DNS", ["googledomains", "google.com"]), ("Azure DNS", ["azure"]),
    ("GoDaddy", ["godaddy", "domaincontrol"]), ("Namecheap", ["namecheap"]),
    ("DigitalOcean", ["digitalocean"]),
]

# --- fixed values: alert life cycle ---------------------------------------------------
ALERT_TYPES = ["malicious_url", "suspicious_ip", "high_traffic", "dns_anomaly",
               "geolocation_mismatch", "frequency_attack", "other"]
SEVERITIES = ["critical", "high", "medium", "low"]
STATUSES = ["new", "acknowledged", "investigating", "resolved", "false_positive"]
TRANSITIONS = {
    "new": ["acknowledged", "investigating", "resolved", "false_positive"],
    "acknowledged": ["investigating", "resolved", "false_positive"],
    "investigating": ["resolved", "false_positive"],
    "resolved": ["investigating"],
    "false_positive": ["investigating"],
}
ACTIVE_STATUSES = ["new", "acknowledged", "investigating"]
ACTIVE_STATUSES_SUMMARY = ["new", "investigating"]
CLOSED_STATUSES = ["resolved", "false_positive"]

# --- own texts: what a feature is, and why it matters (label, reason) ----------------------
FEATURE_DESCRIPTIONS = {
    "url_length": ("Characters in the URL", "Padding pushes the real destination out of sight"),
    "normalized_length": ("Characters after normalisation", "A large change hints at disguised text"),
    "decoded_length": ("Characters after decoding", "Encoded text shrinks when it is decoded"),
    "hostname_length": ("Characters in the host", "Long hosts hide where the registered part begins"),
    "domain_length": ("Characters in the registered domain", "Short names are taken, so throwaway ones run long"),
    "subdomain_length": ("Characters in front of the domain", "A long prefix can imitate another host"),
    "path_length": ("Characters in the path", "Kits unpack into deep folders"),
    "query_length": ("Characters in the query", "Stolen or tracking data travels in the query"),
    "fragment_length": ("Characters in the fragment", "Scripts read targets from the fragment"),
    "dot_count": ("Dots", "Each dot can fake another level of a host"),
    "hyphen_count": ("Hyphens", "Brand names are glued to bait words with hyphens"),
    "underscore_count": ("Underscores", "Host names rarely contain them"),
    "slash_count": ("Slashes", "Nested folders of a hacked site show up here"),
    "question_mark_count": ("Question marks", "More than one points to an embedded URL"),
    "equal_count": ("Equals signs", "Many assignments mean many passed values"),
    "ampersand_count": ("Ampersands", "They join the values a page is given"),
    "at_count": ("At signs", "Text before an at sign is not the host"),
    "colon_count": ("Colons", "Ports and inner schemes add colons"),
    "percent_encoding_count": ("Percent-encoded characters", "Encoding keeps words away from filters"),
    "digit_count": ("Digits", "Generated names and numeric hosts use them"),
    "letter_count": ("Letters", "Readable addresses are mostly letters"),
    "special_character_count": ("Unusual characters", "Rare symbols are there for a purpose"),
    "digit_ratio": ("Share of digits", "People choose words, generators choose numbers"),
    "special_ratio": ("Share of unusual characters", "A high share makes the address hard to read"),
    "entropy": ("Randomness of the URL", "Random text is chosen by programs"),
    "hostname_entropy": ("Randomness of the host", "Generated domains look like noise"),
    "path_entropy": ("Randomness of the path", "One-off links carry random tokens"),
    "subdomain_count": ("Levels in front of the domain", "Free hosting hands out deep names"),
    "domain_token_count": ("Words in the domain", "Compound names combine a brand with bait"),
    "tld_length": ("Characters in the top-level domain", "New endings are longer and cheaper"),
    "longest_token_length": ("Longest word", "An endless word is a token, not a name"),
    "is_https": ("Encrypted connection", "Plain connections expose what is typed"),
    "has_port": ("Explicit port", "Public sites seldom spell out a port"),
    "port": ("Port number", "High ports belong to improvised servers"),
    "non_standard_port": ("Unexpected port", "The port does not belong to the scheme"),
    "is_ip_host": ("Bare address as host", "No name was registered for this server"),
    "is_private_ip": ("Internal address as host", "The target lies inside a network"),
    "is_punycode": ("Encoded international name", "Foreign letters can look like Latin ones"),
    "has_unicode": ("Non-ASCII host", "Look-alike letters need them"),
    "suspicious_tld": ("Risky top-level domain", "Abuse gathers where domains cost nothing"),
    "suspicious_keywords_count": ("Bait words", "Words about accounts and payments attract victims"),
    "suspicious_file_extension": ("Program download", "The link ends in something that runs"),
    "has_hex_chars": ("Hexadecimal escapes", "Escapes make plain words unreadable"),
    "has_double_encoding": ("Encoded twice", "The second layer survives one decoding"),
    "has_at_symbol": ("At sign present", "The visible name may not be the target"),
    "has_userinfo": ("User name in the URL", "Credentials in front of a host mislead the eye"),
    "url_depth": ("Folder levels", "Pages planted in other sites lie deep"),
    "query_param_count": ("Parameters", "Many parameters describe the visitor"),
    "has_query": ("Query present", "The page receives input"),
    "has_fragment": ("Fragment present", "The page has a part chosen in the link"),
    "unique_char_count": ("Different characters", "Random text uses the whole alphabet"),
    "unique_char_ratio": ("Variety of characters", "Few repeats mean little natural language"),
    "dns_a_count": ("IPv4 records", "Many addresses may be a rotating pool"),
    "dns_aaaa_count": ("IPv6 records", "Lasting sites publish them"),
    "dns_mx_count": ("Mail servers", "A business can receive mail"),
    "dns_ns_count": ("Name servers in DNS", "Serious zones have several"),
    "dns_txt_count": ("Text records", "Verified services leave text records"),
    "dns_has_a": ("Has IPv4 records", "Without one most visitors cannot connect"),
    "dns_has_aaaa": ("Has IPv6 records", "Takes some care to set up"),
    "dns_has_mx": ("Accepts mail", "Throwaway domains seldom do"),
    "dns_has_ns": ("Has name servers", "The zone is delegated properly"),
    "dns_has_txt": ("Has text records", "Someone maintains the zone"),
    "dns_has_cname": ("Alias record", "The name points to another one"),
    "dns_has_spf": ("Sender policy", "Limits who may send mail in its name"),
    "dns_has_dmarc": ("Mail authentication policy", "Protects its name against forged mail"),
    "dns_has_dkim": ("Mail signing key", "Signs the mail it sends"),
    "dns_resolution_time_ms": ("Lookup time", "Distant or overloaded servers answer late"),
    "dns_lookup_success": ("Name resolves", "Dead names were taken down or never lived"),
    "dns_mail_provider_google": ("Mail at Google", "A paid mailbox provider knows the owner"),
    "dns_mail_provider_microsoft": ("Mail at Microsoft", "A paid mailbox provider knows the owner"),
    "dns_mail_provider_other": ("Mail elsewhere", "Mail runs at a smaller provider"),
    "dns_provider_cloudflare": ("Zone at Cloudflare", "The origin server is hidden behind a network"),
    "dns_provider_aws": ("Zone at Amazon", "The zone is run in a cloud account"),
    "domain_age_days": ("Days since registration", "Attacks use names that are days old"),
    "days_until_expiry": ("Days until expiry", "Short terms are bought for short use"),
    "is_new_domain": ("Fresh registration", "Too young to have earned trust"),
    "is_expiring_soon": ("About to expire", "Nobody plans to keep the name"),
    "is_privacy_protected": ("Hidden owner", "The registrant cannot be checked"),
    "is_free_tld": ("Free ending", "No payment leaves no trace of the buyer"),
    "new_domain_risk": ("Risk of a young domain", "Falls step by step as the name ages"),
    "whois_nameserver_count": ("Name servers on file", "The registry lists where the zone is kept"),
    "whois_success": ("Registration found", "Registration data could be read"),
    "is_private": ("Private network address", "Unreachable from outside"),
    "is_ipv6": ("Modern address format", "The server is reached by IPv6"),
    "ip_numeric": ("Address as a number", "Neighbouring numbers share an operator"),
    "octet_1": ("First part of the address", "Shows the registry's block"),
    "octet_2": ("Second part of the address", "Narrows the block to a network"),
    "octet_3": ("Third part of the address", "Narrows the network to a segment"),
    "octet_4": ("Last part of the address", "The host within its segment"),
    "threat_score": ("Stored reputation", "What earlier incidents say about the address"),
    "total_requests": ("Requests seen", "How often the address turned up before"),
    "active_threats_count": ("Open threat reports", "Reports that nobody has closed"),
    "is_known_malicious": ("Listed as malicious", "At least one list names the address"),
    "days_since_first_seen": ("Days known", "An unknown address has no record"),
    "abuse_score": ("Abuse rating", "Complaints of other networks, weighted"),
    "total_reports": ("Abuse reports", "Number of complaints"),
    "asn_risk": ("Risk of the operator", "Some operators tolerate abuse"),
    "country_risk": ("Risk of the country", "Where the server stands"),
    "combined_risk": ("Combined address risk", "Ratings of the address in one number"),
    "is_hosting": ("Data centre", "Servers are rented by the hour there"),
    "is_vpn": ("VPN exit", "The real user is elsewhere"),
    "is_tor": ("Tor exit", "Traffic is anonymous by design"),
    "is_proxy": ("Proxy", "Requests are passed on for others"),
    "hosting_provider": ("Known hosting company", "The operator sells servers"),
    "intel_available": ("Ratings found", "Some provider knows the address"),
    "has_geolocation": ("Location known", "The address could be placed on a map"),
    "latitude": ("Degrees north", "Part of the server's position"),
    "longitude": ("Degrees east", "Part of the server's position"),
    "isp_length": ("Length of the provider's name", "Missing names count as zero"),
    "org_exists": ("Organisation named", "Someone stands behind the address"),
    "geo_country_flag": ("Watched country", "The position lies in a watched country"),
    "request_frequency": ("Flows per minute", "Machines keep a pace that people do not"),
    "unique_destinations": ("Different peers", "Scanners talk to everybody once"),
    "protocol_diversity": ("Protocols in use", "Probing tries more than one"),
    "https_ratio": ("Encrypted share of traffic", "Normal browsing is encrypted by now"),
    "avg_payload_size": ("Mean payload", "Probes are small, leaks are large"),
    "port_scan_likelihood": ("Spread over ports", "Touching many ports is a scan"),
    "traffic_burstiness": ("Uneven timing", "Bursts and pauses tell machines apart"),
}
