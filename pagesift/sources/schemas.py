"""Explicit schemas; nothing is inferred."""

# The columns of the tables as they come.
PERMIT_COLUMNS = ("permitNum", "permitType", "permitClass", "estProjectCost", "totalSqFt", "issueDate", "description", "link")
PERMITS = ", ".join(f"{c} string" for c in PERMIT_COLUMNS)
DOWNLOAD_LOG = "doc_id string, status string, bytes long, name string"
SPLIT = """version string, seed int, rules string, train array<string>, eval array<string>,
 stats struct<train:struct<permits:long,pages:long,finish_pages:long>,eval:struct<permits:long,pages:long,finish_pages:long>,
 total_permits:long,total_pages:long,total_finish_pages:long,whales_forced_train:array<struct<permit_num:string,pages:long>>,
 moved_to_eval_to_meet_floors:array<struct<permit_num:string,pages:long,finish_pages:long>>,floors_met:boolean,floors_exhausted_without_meeting:boolean>"""
# The categories of pages.
CATEGORIES = ("floor_plan", "finish_plan", "finish_schedule", "demo_plan", "reflected_ceiling", "furniture_plan", "site_plan", "elevation_section", "detail", "schedule_other", "structural", "mep", "cover_index", "specs_notes", "other", "life_safety")
