"""Table schemas."""

CATALOG = (
    "source string, id string, title string, url string, subtitle string, format_hint string, "
    "extra map<string,string>"
)
CHAPTER = "source string, id string, chapter_idx int, title string, text string"
BOOK = (
    "source string, id string, title string, out_path string, chars int, lines int, format string, "
    "content string, chapters array<struct<title:string,text:string>>, raw binary"
)
STORE = (
    "schema_version int, id string, store_key string, title string, chars int, lines int, format string, "
    "content string, chapters array<struct<title:string,text:string>>, raw binary, saved_ts timestamp, "
    "deleted boolean, source string, batch_id bigint"
)
TREE = (
    "tree array<struct<path:string,mode:string,type:string,sha:string,size:bigint,url:string>>, "
    "truncated boolean"
)
WIKI_SEARCH = "query struct<search:array<struct<title:string,snippet:string,pageid:bigint>>>"
RECORDS = (
    "array<struct<id:string,title:string,author:string,year:string,language:string,extension:string,"
    "filesize:string,md5:string>>"
)
PAGES = "page_id bigint, url string, html string"
CHECKPOINT = "source string, id string, title string, fmt string, idx int"
PROGRESS = "rel string, chapter int, pct int, ts timestamp, event_id bigint"
FETCH_LOG = "host string, ts timestamp, id bigint, ok boolean"
