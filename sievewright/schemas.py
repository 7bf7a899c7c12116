"""Row types of the engine's tables, as DDL."""

SOURCE = "ord long, url string, title string, source_name string, company_name string, company_type string, location string, is_official boolean, relevance_score int, reason string"
PAGE = "ord long, url string, source_name string, title string, text string, html string, metadata map<string,string>, status_code int, final_url string, content_type string, fetch_method string, attempts int, fetch_error string"
LINK = "struct<url:string,text:string,kind:string,reason:string>"
AI_PAGE = f"ord long, url string, final_url string, source_name string, source_company_name string, company_type string, source_location string, is_official boolean, title string, visible_text string, important_links array<{LINK}>"
FOLLOWUP = "ord long, url string, title string, source_name string, company_name string, company_type string, is_official boolean, pending_kind string, suggested_next_action string, priority int, reasons array<string>, links array<map<string,string>>, stage string"
RAW_JOB = (
    "ord long, company_name string, company_type string, title string, locations array<string>, description string, requirements string, recruitment_type string, graduation_years array<string>, "
    "graduation_start string, graduation_end string, graduation_requirement string, education_levels array<string>, deadline string, source_name string, source_url string, apply_url string, is_official boolean"
)
JOB = RAW_JOB + ", id long, deduplication_key string, status string, notes string, first_seen_at string, last_seen_at string, created_at string, updated_at string"
ASSESSMENT = "deduplication_key string, match_score int, recommendation string, role_fit string, must_have_fit string, confidence string, match_reasons array<string>, missing_requirements array<string>, risk_flags array<string>, analysis_source string, score_components map<string,int>"
PROFILE = "education string, graduation_date string, target_roles array<string>, skills array<string>, preferred_company_types array<string>, preferred_locations array<string>, excluded_locations array<string>"
EXTRACTION = "page_id string, page_context struct<company_name:string,recruitment_type:string,graduation_years:array<string>,graduation_start:string,graduation_end:string,graduation_requirement:string,deadline:string,education_levels:array<string>>, jobs array<struct<title:string,locations:array<string>,description:string,requirements:string>>"
UNDERSTANDING = "canonical_role string, role_family string, seniority string, confidence string, responsibilities array<string>, requirements array<struct<category:string,text:string,evidence:string>>, work_context array<string>, risk_flags array<string>"
