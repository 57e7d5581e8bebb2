"""Fixed schemas of what is read, so that nothing is inferred from the data."""

PAIR = "struct<en:string,zh:string>"
ARTICLE = "source string, country string, title string, url string, published_at string, author string, section string, body string, description string, fetched_at string, tags array<string>"
CRAWL = f"source string, fetched_at string, since string, requested int, count int, failures array<struct<url:string,reason:string>>, articles array<struct<{ARTICLE.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>>, _corrupt_record string"
CONTENT = (
    f"coreNews:struct<originalTitle:string,displayTitle:{PAIR},publisher:string,publishedAt:string,sourceUrl:string,summary:{PAIR},keyFacts:array<struct<text:{PAIR},sourceId:string>>>,"
    f"centralInsight:{PAIR},keyTakeaway:{PAIR},"
    f"dimensions:array<struct<title:{PAIR},relationship:string,insight:{PAIR},supportingFacts:array<struct<text:{PAIR},sourceId:string,confidence:string>>,"
    f"metrics:array<struct<label:{PAIR},value:double,unit:{PAIR},period:{PAIR},comparisonValue:double,comparisonPeriod:{PAIR},sourceId:string>>,suggestedPresentation:string>>,"
    f"timeline:array<struct<date:string,event:{PAIR},sourceId:string>>,whatToWatch:array<{PAIR}>,uncertainties:array<{PAIR}>,"
    f"sources:array<struct<id:string,title:{PAIR},publisher:string,publishedAt:string,url:string>>"
)
PACKET = f"schemaVersion int, source string, fetchedAt string, model string, articles array<struct<status:string,coreNews:struct<url:string,body:string,title:string,published_at:string>,infographicContent:struct<{CONTENT}>>>, _corrupt_record string"
JOB = "id string, status string, stage string, pid long, startedAt timestamp, updatedAt timestamp, result struct<count:long,failures:long>, _corrupt_record string"
EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
SITE = "id string, source string, country string, latestUrl string, timezone string, articleLimit int, candidateLimit int, selectors map<string,string>, feedUrls array<string>, _corrupt_record string"
