"""Columns of the catalog's tables."""

BOOK = """id long, kind string, files array<string>, extras array<string>, src_display string, author string, title string,
series string, series_index string, status string, meta_source string, narrator string, fingerprint string, year string,
publisher string, description string, genres string, language string, asin string, isbn string, duration double,
bitrate int, codec string, chapters int, health string, cover string, cover_info string,
cover_candidates array<struct<path:string,origin:string,w:int,h:int,score:double>>, confidence int, match_bonus int,
online_best struct<source:string,title:string,author:string,series:string,series_index:string,narrator:string,year:string,
score:double,runtime:int,asin:string,isbn:string>, ai struct<title:string,author:string,confidence:int,pending:boolean>,
transcript string, locked array<string>, enriched boolean, dup_skipped boolean, flags array<string>"""
FILE = "rel_path string, dir string, name string, ext string, size long, mtime timestamp"
FINGERPRINTS = "path string, size long, mtime timestamp, fp string"
CORRECTIONS = "fp string, fields map<string,string>, ts timestamp"
ALIASES = "variant_key string, canonical string, ts timestamp"
REJECTS = "a string, b string"
NOT_DUPES = "key string, ts timestamp"
CACHE = "key string, value string, ts timestamp"
JOURNAL = "id long, ts timestamp, action string, src string, dest string, detail string"
CANDIDATE = """source string, asin string, title string, subtitle string, author string, narrator string, series string,
series_index string, runtime int, year string, publisher string, language string, description string, genres string,
cover_url string, isbn string"""
EDGE = "src long, dst long, reason string, score int"
