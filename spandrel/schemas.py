"""The schemas of the crawl's tables."""

TAGS = ("og_title", "og_description", "og_image", "og_url", "og_type", "og_site_name", "og_locale")
OPEN_GRAPH = "struct<" + ",".join(f"{t}:string" for t in TAGS) + ">"
LINK = "struct<url:string,text:string,is_external:boolean,status_code:int,redirected_url:string,check_error:string>"
IMAGE = "struct<src:string,alt:string>"
ISSUE = "struct<severity:string,issue_type:string,message:string>"
PAGE = f"url string, status_code int, content_type string, title string, meta_description string, h1_tags array<string>, links array<{LINK}>, images array<{IMAGE}>, issues array<{ISSUE}>, open_graph {OPEN_GRAPH}, crawl_depth int"
PAGE_STRUCT = "struct<" + ",".join(f"{x.split(' ', 1)[0]}:{x.split(' ', 1)[1]}" for x in PAGE.split(", ")) + ">"
FETCH = "url string, page_key string, depth int, seq bigint, status_code int, content_type string, body string, final_url string, error string"
PROBE = "url string, outcome string, status_code int, redirected_url string, error string"
ISSUES = "page_key string, issue_idx int, severity string, issue_type string, message string"
# Names of severities and issue types.
SEVERITIES = ("Error", "Warning", "Info")
ISSUE_TYPES = "BrokenLink MissingTitle MissingMetaDescription TitleTooShort TitleTooLong MetaDescriptionTooShort MetaDescriptionTooLong MissingH1 MultipleH1 MissingImageAlt ThinContent MissingOgTitle MissingOgDescription MissingOgImage MissingOgUrl MissingOgType Redirect".split()
