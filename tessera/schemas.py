"""Explicit schemas of the tables that are read from files. Nothing is inferred."""

RAW_POSTS = "id string, text string, side string, tradition string, source string, date string"
EVIDENCE = ("church_id string, feature string, value string, tier string, quote string, url string, source_kind string, how string, "
            "checked_at timestamp, note string")
MEMORY_LOG = ("session_id string, id bigint, t int, op string, key string, vals array<string>, stance string, strength double, conf double, "
              "src string, ev string, why string, supersedes string, ts timestamp, "
              "location struct<text:string,lat:double,lng:double,limit_miles:double>")
CALL_LOG = "task string, model string, ok boolean, ms bigint, prompt_tokens bigint, completion_tokens bigint, repairs bigint"
STEP_LOG = ("ts timestamp, session_id string, church_id string, stage int, step int, action string, why string, result_summary string, "
            "features_moved array<string>, ms bigint")
PLACES_PAGE = ("places array<struct<id:string,displayName:struct<text:string>,formattedAddress:string,location:struct<latitude:double,longitude:double>,"
               "websiteUri:string,nationalPhoneNumber:string,businessStatus:string,types:array<string>>>, nextPageToken string")
MAP_ELEMENTS = ("elements array<struct<type:string,id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>")
KB_EVIDENCE = "array<struct<action:string,quote:string,url:string,source_type:string,confidence:string,human_decision:string>>"
KB_DOCUMENT = ("groups array<struct<id:string,census_name:string,name:string,census_2020:struct<congregations:double,adherents:double,share:double>,"
               f"processed:boolean,fields:map<string,struct<value:string,status:string,evidence:{KB_EVIDENCE}>>>>")
FEATURES = ("feature string, label string, values array<string>, ask string, question string, stage int, sources array<string>, denom_field string, "
            "sensitive boolean, observed boolean, ord int")
REVIEW_SHEET = ("tier string, term string, category string, term_types string, senses string, disambiguation_question string, neutral_options string, "
                "example_contexts string, keep string, types_ok string, features_ok string, neutral_ok string, notes string")
PROPOSAL_SHEET = ("group string, group_id string, field_id string, action string, old_value string, old_status string, new_value string, quote string, "
                  "url string, source_type string, source_id string, confidence string, model string, checked_at string, verify_verdict string, "
                  "verify_reason string, verify_model string, applied string, review_decision string, review_notes string")
EPISODE_ITEM = ("title string, guid string, pubDate string, link string, `itunes:duration` string, `itunes:episodeType` string, `itunes:author` string, "
                "`dc:creator` string, author string, "
                "enclosure array<struct<_url:string,_type:string,_length:string>>, "
                "`podcast:transcript` array<struct<_url:string,_type:string>>, `itunes:transcript` array<struct<_url:string,_type:string>>")
