"""The queries' equivalents for DuckDB."""

from __future__ import annotations

OPTIONS = "(values (1,'sat_18_00','Sat 6:00 PM CST (30 min)',5,18,0), (2,'sun_11_00','Sun 11:00 AM CST (30 min)',6,11,0), (3,'sun_15_00','Sun 3:00 PM CST (30 min)',6,15,0), (4,'sun_18_00','Sun 6:00 PM CST (30 min)',6,18,0)) o(slot_no, slot_key, label, weekday, hour, minute)"
AHEAD = "case when {w} - (isodow({d}) - 1) <= 0 then {w} - (isodow({d}) - 1) + 7 else {w} - (isodow({d}) - 1) end"


def _next(day: str, weekday: str) -> str:
    return f"(({day})::date + ({AHEAD.format(d=day, w=weekday)})::int)"


def _utc(local: str) -> str:
    return f"((({local}) at time zone 'America/Chicago') at time zone 'UTC')"


BOOKINGS = """b as (select o_orderkey as booking_id, o_orderdate as created, 'customer ' || o_custkey as name,
  case when o_orderkey % 5 = 0 then '' when o_orderkey % 7 = 0 then null else 'c' || o_custkey || '@example.com' end as email,
  ['sat_18_00','sun_11_00','sun_15_00','elsewhere'][o_orderkey % 4 + 1] as slot_key, 'priority ' || o_orderpriority || ' & "more"' as message,
  case o_orderstatus when 'F' then 'https://calendar.example.com/' || o_orderkey when 'O' then '' end as event_link,
  case when o_orderstatus = 'F' and o_orderkey % 3 = 0 then 'https://meet.example.com/' || o_orderkey end as meet_link,
  case o_orderstatus when 'F' then 'confirmed' when 'O' then '' end as raw_status,
  coalesce(nullif(trim(case o_orderstatus when 'F' then 'confirmed' when 'O' then '' end), ''), 'pending') as status from orders)"""
SLOTTED = f"""{BOOKINGS}, f as (select b.*, coalesce(o.weekday, 6) as weekday, coalesce(o.hour, 18) as hour, coalesce(o.minute, 0) as minute from b left join {OPTIONS} using (slot_key)),
t as (select *, {_next('created::date', 'weekday')}::timestamp + to_hours(hour) + to_minutes(minute) as start_local from f),
u as (select *, {_utc('start_local')} as start_utc, {_utc('start_local')} + interval 30 minute as end_utc from t)"""
CALENDAR = f"""staff as (select distinct user_id as staff_id from events), busy as (select user_id as staff_id, ts as busy_start, ts + interval 30 minute as busy_end from events where event_type = 'purchase'),
w as (select staff_id, k::int as week, o.*, {_next("(date '2024-01-01' + k::int * 7)", 'weekday')}::timestamp + to_hours(hour) + to_minutes(minute) as start_local from staff, {OPTIONS}, range(4) r(k)),
c as (select staff_id, week, slot_no, slot_key, label, start_local, start_local + interval 30 minute as end_local, {_utc('start_local')} as start_utc, {_utc('start_local + interval 30 minute')} as end_utc from w)"""
AVAILABLE = f"""{CALENDAR}, x as (select c.*, staff_id % 11 <> 0 as checked, staff_id % 7 <> 0 as ok, exists (select 1 from busy where busy.staff_id = c.staff_id and busy_start < end_utc and busy_end > start_utc) as taken from c),
a as (select *, case when checked and ok then not taken end as available, checked and ok as availability_known, case when not checked then true else coalesce(case when checked and ok then not taken end, false) end as offered from x)"""
ACTIONS = """act as (select event_id as action_id, user_id * 100 + day(ts) as booking_id, ts as at_ts, event_type,
  case event_type when 'signup' then 'created' when 'view' then 'event_created' when 'click' then 'email_marked' when 'purchase' then 'confirmed' else 'email_sent' end as action,
  case when event_type = 'view' then 'https://calendar.example.com/' || event_id else '' end as event_link,
  case when event_type = 'view' and event_id % 2 = 0 then 'https://meet.example.com/' || event_id end as meet_link from events)"""
STATE = f"""with {ACTIONS} select booking_id, coalesce(max(case when action in ('event_created', 'confirmed', 'email_sent') then 'confirmed' end), 'pending') as status,
  max(at_ts) filter (action in ('event_created', 'confirmed')) as confirmed_utc, max(at_ts) filter (action in ('email_sent', 'email_marked')) as email_sent_utc,
  struct_extract(max({{'at': at_ts, 'link': event_link}}) filter (event_link <> ''), 'link') as event_link, struct_extract(max({{'at': at_ts, 'link': meet_link}}) filter (meet_link <> ''), 'link') as meet_link from act group by booking_id"""
CATALOGUE = "cat as (select p_partkey as id, p_name as title, p_type as summary, p_brand as brand, case p_size % 3 when 0 then [p_brand, p_type] when 1 then []::varchar[] end as courses from part)"


def _quote(x: str) -> str:
    return f"replace(replace(url_encode({x}), '%7E', '~'), '%2F', '/')"


OVER = "exists (select 1 from busy where busy.staff_id = c.staff_id and busy_start < end_utc and busy_end > start_utc)"
REQUEST = """'{{"summary":"Session with ' || name || '","description":"' || replace(message, '"', '\\"') || '","start":{{"dateTime":"' || strftime(start_utc, '%Y-%m-%dT%H:%M:%SZ') || '","timeZone":"UTC"}},"end":{{"dateTime":"' || strftime(end_utc, '%Y-%m-%dT%H:%M:%SZ')
  || '","timeZone":"UTC"}},"attendees":[' || {people} || '{{"email":"office@example.com"}}],"conferenceData":{{"createRequest":{{"requestId":"' || sha256(length(booking_id::varchar) || ':' || booking_id::varchar) || '"}}}}}}'"""
MESSAGE = "'Hi ' || coalesce(nullif(name, ''), 'there') || ', your session ' || coalesce(slot_key, '') || ' is confirmed.' || case when meet_link <> '' then ' Join: ' || meet_link else '' end"
LANDED = "land as (select user_id * 100 + day(ts) as booking_id, event_id, ts as at_ts, 'https://calendar.example.com/' || event_id as event_link, case when event_id % 3 = 0 then 'last:' || event_id end as meet_link from events where event_type = 'view')"

SQL = {
    "slot_options": f"select o.*, (select count(*) from events where isodow(ts) - 1 = o.weekday) as n_events from {OPTIONS}",
    "staff_slots": f"select staff_id, slot_no, slot_key from (select distinct user_id as staff_id from events), {OPTIONS}",
    "slot_fields": f"with {SLOTTED} select booking_id, slot_key, weekday, hour, minute from f",
    "slot_calendar": f"with {CALENDAR} select * from c",
    "next_weekday": f"select o_orderkey, {_next('o_orderdate::date', '(o_orderkey % 7)')} ::varchar as next_day, {_next('o_orderdate::date', '6')}::varchar as next_sunday from orders",
    "slot_times": f"with {SLOTTED} select booking_id, start_local, start_local + interval 30 minute as end_local from u",
    "slot_utc": f"with {BOOKINGS} select booking_id, {_utc('created')} as created_utc from b",
    "slot_iso": f"with {SLOTTED} select booking_id, strftime(start_local, '%Y-%m-%dT%H:%M:%S') || case when date_diff('minute', start_utc, start_local) = -300 then '-05:00' else '-06:00' end as start_iso from u",
    "compact_utc": f"with {SLOTTED} select booking_id, strftime(start_utc, '%Y%m%dT%H%M%SZ') as start_compact from u",
    "parse_slot": f"with {SLOTTED} select booking_id, start_utc from u",
    "open_slots": f"with {CALENDAR} select staff_id, slot_key, start_utc, end_utc from c where not {OVER}",
    "open_slots_merged": f"with {CALENDAR} select staff_id, slot_key, start_utc, end_utc from c where not {OVER}",
    "merged_busy": """with e as (select user_id as staff_id, ts as s, ts + case event_type when 'signup' then interval 30 day else interval 6 hour end as t from events where event_type in ('click', 'purchase') or event_type = 'signup' and user_id % 11 = 0),
m as (select *, max(t) over (partition by staff_id order by s, t rows between unbounded preceding and 1 preceding) as until from e),
g as (select *, sum(case when s <= until then 0 else 1 end) over (partition by staff_id order by s, t rows unbounded preceding) as island from m)
select staff_id, min(s) as busy_start, max(t) as busy_end from g group by staff_id, island""",
    "taken_slots": f"with {CALENDAR} select staff_id, slot_key, start_utc, end_utc from c where {OVER}",
    "slot_availability": f"with {AVAILABLE} select staff_id, start_utc, slot_no, available, availability_known, offered from a",
    "slot_fallback": f"with {AVAILABLE}, n as (select *, sum(offered::int) over (partition by staff_id) as n_open from a) select staff_id, start_utc, slot_no, offered, n_open = 0 as fallback from n where offered or n_open = 0",
    "any_open": f"with {AVAILABLE} select staff_id, bool_or(offered) as any_open, count(*) filter (offered) as n_open from a group by staff_id",
    "open_labels": f"with {AVAILABLE} select staff_id, coalesce(string_agg(label, '; ' order by week, slot_no) filter (offered), '') as labels from a group by staff_id",
    "availability_map": f"with {AVAILABLE} select staff_id, count(*)::int as n_slots, string_agg(strftime(start_utc, '%Y%m%dT%H%M%SZ') || '=' || offered, ';' order by start_utc) as slots from a group by staff_id",
    "freebusy_json": f"with {CALENDAR} select * from busy where staff_id % 5 <> 0",
    "busy_count": f"with {CALENDAR} select staff_id, staff_id % 5 <> 0 as calendar_known, case when staff_id % 5 <> 0 then (select count(*) from busy where busy.staff_id = staff.staff_id) else 0 end::int as n_busy, case when staff_id % 5 <> 0 then (select count(*) from busy where busy.staff_id = staff.staff_id) else 0 end = 0 as free from staff",
    "freebusy_request": f"""with {CALENDAR} select staff_id, start_utc, '{{"timeMin":"' || strftime(start_utc, '%Y-%m-%dT%H:%M:%SZ') || '","timeMax":"' || strftime(end_utc, '%Y-%m-%dT%H:%M:%SZ') || '","items":[{{"id":"' || staff_id || '"}}]}}' as request from c""",
    "scan_bookings": f"with {BOOKINGS} select created, name, coalesce(email, '') as email, slot_key as slot_label, message || ',' || chr(10) || booking_id as message, coalesce(event_link, '') as event_link from b",
    "scan_headers": f"""with {BOOKINGS} select created, name, message || ',' || chr(10) || booking_id as message, case booking_id % 3 when 0 then coalesce(email, '') else '' end as email, case booking_id % 3 when 1 then coalesce(event_link, '') else '' end as event_link,
  case booking_id % 3 when 2 then coalesce(meet_link, '') else '' end as meet_link, case booking_id % 3 when 2 then slot_key else '' end as slot_label, case booking_id % 3 when 0 then '' else coalesce(raw_status, '') end as status from b""",
    "status_filter": f"with {BOOKINGS} select booking_id, status from b where status = 'pending'",
    "distinct_status": f"with {BOOKINGS} select distinct status from b",
    "status_options": f"with {BOOKINGS} select 0 as place, 'all' as status union all select row_number() over (order by status)::int, status from (select distinct status from b)",
    "status_funnel": f"with {BOOKINGS} select status, slot_key, count(*) as n from b group by all",
    "get_default": f"with {BOOKINGS} select booking_id, coalesce(email, '-') as email, coalesce(meet_link, '') as meet_link from b",
    "param_default": f"with {BOOKINGS} select booking_id, coalesce(nullif(email, ''), 'office@example.com') as reply_to from b",
    "has_link": f"with {BOOKINGS} select booking_id, event_link from b where event_link is not null and event_link <> ''",
    "needs_event": f"with {BOOKINGS} select booking_id from b where event_link is null or event_link = ''",
    "review_rows": f"with {BOOKINGS} select booking_id, concat_ws(' - ', name, email, slot_key) as title, status, message, concat_ws(' ', nullif(event_link, ''), nullif(meet_link, '')) as links from b",
    "review_numbered": f"with {BOOKINGS} select booking_id, status, row_number() over (partition by status, created::date order by created, booking_id)::int as number from b",
    "label_to_key": f"with {CALENDAR} select staff_id, week, slot_no, slot_key from c",
    "review_list": f"with {BOOKINGS} select booking_id, row_number() over (order by created, booking_id) as number from b where status = 'pending'",
    "append_union": f"with {BOOKINGS} select booking_id, created, 'bookings' as origin from b union all select event_id, ts, 'events' from events where event_type = 'signup'",
    "union_by_name": f"with {BOOKINGS} select booking_id, name, case when booking_id % 2 = 1 then raw_status end as status from b",
    "append_log": f"with {BOOKINGS} select year(created)::int as year, count(*) as n, count(distinct created::date) as n_days, max(booking_id) as last_id from b group by 1",
    "rewrite_log": f"with {BOOKINGS} select booking_id, name, case when booking_id % 2 = 1 then raw_status end as status, case when booking_id % 2 = 1 then meet_link end as meet_link from b",
    "truncate_log": "select count(*) as n_before, 0::bigint as n_after, 3 as n_columns from orders",
    "apply_updates": f"with {BOOKINGS} select booking_id, case when booking_id % 3 = 0 then 'confirmed' else raw_status end as status, case when booking_id % 6 = 0 then 'moved' else event_link end as event_link from b",
    "booking_state": STATE,
    "booking_state_stream": STATE,
    "booking_state_versions": STATE,
    "booking_state_delta": STATE,
    "booking_state_bucketed": STATE,
    "intake_log": f"with {ACTIONS}, d as (select distinct case when action_id % 7 <> 0 then action_id end as action_id, booking_id, at_ts, action, event_link, meet_link from act) select action_id, booking_id, action from d",
    "answered_requests": f"with {ACTIONS} select r.action_id as request_id, r.booking_id, a.action_id as answer_id from act r left join act a on a.event_type = 'view' and a.booking_id = r.booking_id and a.at_ts between r.at_ts and r.at_ts + interval 12 hour where r.event_type = 'click'",
    "intake_stream": f"with {ACTIONS} select action_id, booking_id, action from act",
    "dedup_bookings": f"with {ACTIONS} select booking_id, action_id, event_link from act qualify row_number() over (partition by booking_id order by (event_link <> '') desc, at_ts desc, action_id desc) = 1",
    "collapse_bookings": f"with {SLOTTED} select name, email, start_local as slot_local_start, booking_id, event_link from u qualify row_number() over (partition by name, email, start_local order by coalesce(event_link, '') <> '' desc, created desc, booking_id desc) = 1",
    "double_bookings": "with e as (select user_id as staff_id, event_id as id, ts as s, ts + interval 30 minute as t from events where event_type in ('click', 'purchase')) select a.staff_id, a.id as id_a, b.id as id_b from e a join e b on a.staff_id = b.staff_id and a.id < b.id and a.s < b.t and b.s < a.t",
    "catalogue_search": f"with {CATALOGUE} select id, title, summary from cat where contains(lower(title || summary), 'ne')",
    "program_lookup": f"with {CATALOGUE} select id, title, (select count(*) from lineitem where l_partkey = 7) as n_lines from cat where id = 7",
    "selected_detail": f"with {CATALOGUE} select l_orderkey, l_linenumber, l_partkey * 2 as program_id, title, summary, id is not null as found from lineitem left join cat on id = l_partkey * 2",
    "has_courses": f"with {CATALOGUE} select id, len(courses)::int as n_courses from cat where len(courses) > 0",
    "default_choice": f"with {CATALOGUE}, d as (select *, coalesce(nullif(case id % 3 when 0 then summary when 1 then '' end, ''), courses[1]) as chosen from cat) select id, chosen, greatest(coalesce(list_position(courses, chosen), 0) - 1, 0)::int as place from d",
    "assign_instructor": f"with {CATALOGUE} select id, case when brand in ('Brand#11', 'Brand#12') then 'staff_a' else 'staff_b' end as instructor from cat",
    "staff_email": f"with {BOOKINGS} select booking_id, case when starts_with(name, 'customer 1') then 'a@example.com' else 'b@example.com' end as staff_email from b",
    "course_branch": f"with {CATALOGUE} select id, case when brand = 'Brand#11' then 'exact' when starts_with(brand, 'Brand#1') then 'prefix' else 'other' end as branch from cat",
    "inquiry_text": f"with {CATALOGUE} select id, 'Interested in ' || title || case when courses[1] <> '' then ' (' || courses[1] || ')' else '' end as inquiry from cat",
    "round_robin": f"with {CATALOGUE} select id, ((row_number() over (partition by brand order by id) - 1) % 3)::int as bucket from cat",
    "message_body": f"with {BOOKINGS} select booking_id, {MESSAGE} as body from b",
    "outreach_feed": f"with {BOOKINGS} select booking_id, email as recipient, 'Session ' || coalesce(slot_key, '') as subject, {MESSAGE} as body from b where trim(email) <> ''",
    "url_quoted": f"with {BOOKINGS} select booking_id, {_quote("message || ' ~*/+é'")} as quoted from b",
    "calendar_link": f"with {SLOTTED} select booking_id, 'https://calendar.example.com/render?action=TEMPLATE&text=' || {_quote('name')} || '&dates=' || strftime(start_utc, '%Y%m%dT%H%M%SZ') || '/' || strftime(end_utc, '%Y%m%dT%H%M%SZ') || '&details=' || {_quote('message')} as link from u",
    "request_ids": f"with {BOOKINGS} select booking_id, sha256(coalesce(length(name) || ':' || name, '-') || coalesce(length(email) || ':' || email, '-') || coalesce(length(slot_key) || ':' || slot_key, '-')) as request_id from b",
    "event_links": f"with {LANDED} select event_id, event_link, meet_link from land",
    "event_request": f"with {SLOTTED} select booking_id, {REQUEST.format(people="''")} as request from u",
    "event_requests": f"""with {SLOTTED} select booking_id, {REQUEST.format(people="case when email <> '' then '{\"email\":\"' || email || '\"},' else '' end")} as request from u where event_link is null or event_link = ''""",
    "merge_responses": f"""with {ACTIONS}, {LANDED}, s as (select booking_id, coalesce(max(case when action in ('confirmed', 'email_sent') then 'confirmed' end), 'pending') as status, struct_extract(max({{'at': at_ts, 'link': event_link}}) filter (event_link <> ''), 'link') as event_link,
  struct_extract(max({{'at': at_ts, 'link': meet_link}}) filter (meet_link <> ''), 'link') as meet_link from act where event_type <> 'view' group by booking_id),
r as (select * from land qualify row_number() over (partition by booking_id order by at_ts desc, event_link desc) = 1)
select s.booking_id, case when r.booking_id is not null then 'confirmed' else s.status end as status, coalesce(r.event_link, s.event_link) as event_link, coalesce(r.meet_link, s.meet_link) as meet_link, r.at_ts as confirmed_utc from s left join r using (booking_id)""",
    "linked_share": f"with {BOOKINGS} select created::date::varchar as day, count(*) as n, count(*) filter (event_link <> '') as n_linked from b group by 1",
}
