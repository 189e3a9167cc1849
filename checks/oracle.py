"""SQL with the expected result of each registered query, for DuckDB.

Written from the definitions, not from the library: areas are spelled out as
comparisons, estimates as one step per try, parsed values as the values the
texts were made from.
"""

from __future__ import annotations

import math

from checks import queries as q
from checks import sample

# The columns of a layer, the statistics of a full reply and the bins of its histograms.
LAYER_COLUMNS = [
    "vendor_id", "pickup_datetime", "dropoff_datetime", "passenger_count", "trip_distance", "pickup_longitude", "pickup_latitude",
    "pickup_location", "store_and_fwd_flag", "rate_code_id", "dropoff_longitude", "dropoff_latitude", "dropoff_location", "payment_type",
    "fare_amount", "extra", "mta_tax", "improvement_surcharge", "tip_amount", "tolls_amount", "total_amount", "trip_type", "ehail_fee",
    "time_of_day_sec", "cab_type",
]
SUMMARIES = ["passenger_count", "trip_distance", "fare_amount", "tip_amount", "tolls_amount", "total_amount"]
HISTOGRAMS = {"vendor_id": (0, 2), "rate_code_id": (1, 6), "payment_type": (0, 6), "cab_type": (0, 2)}

TRIPS = sample.TRIPS.format(epoch=sample.DUCK_EPOCH.format("l_shipdate"))
CELLS = sample.CELLS.format(epoch=sample.DUCK_EPOCH.format("l_shipdate"))
VALID = (
    f"select * from ({TRIPS}) where pickup_longitude <> 0 and pickup_latitude <> 0 "
    "and dropoff_longitude <> 0 and dropoff_latitude <> 0 and time_of_day_sec <> 0"
)
IDS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def num(value: float) -> str:
    """Double literal; a bare decimal would be DECIMAL."""
    text = repr(float(value))
    return text if "e" in text else text + "e0"


# Areas


def _in_box(box, x: str, y: str) -> str:
    xmin, ymin, xmax, ymax = box
    return f"({x} between {num(xmin)} and {num(xmax)} and {y} between {num(ymin)} and {num(ymax)})"


def _side(x: str, y: str, x1: str, y1: str, x2: str, y2: str, dx: str | None = None, dy: str | None = None) -> str:
    return f"(({y} - {y1}) * {dx or f'({x2} - {x1})'} - ({x} - {x1}) * {dy or f'({y2} - {y1})'})"


def _corners(x: float, y: float, radius: float) -> list[tuple[float, float]]:
    angles = [2 * math.pi / 20 * i for i in range(20)]
    out = [(radius * math.cos(a) + x, radius * math.sin(a) + y) for a in angles]
    return out + out[:1]


def _sides(ring, x: str, y: str) -> list[tuple[str, tuple]]:
    return [
        (_side(x, y, num(a[0]), num(a[1]), "", "", num(b[0] - a[0]), num(b[1] - a[1])), (a, b))
        for a, b in zip(ring, ring[1:], strict=False)
    ]


def _in_circle(circle, x: str, y: str) -> str:
    return "(" + " and ".join(f"{side} >= 0" for side, _ in _sides(_corners(*circle), x, y)) + ")"


def _in_polygon(rings, x: str, y: str) -> str:
    crossings, touches = [], []
    for ring in rings:
        for side, (a, b) in _sides([*ring, ring[0]], x, y):
            up = "true" if b[1] > a[1] else "false"
            crossings.append(
                f"case when ({num(a[1])} <= {y}) <> ({num(b[1])} <= {y}) and ({side} > 0) = {up} then 1 else 0 end"
            )
            near = _in_box((min(a[0], b[0]), min(a[1], b[1]), max(a[0], b[0]), max(a[1], b[1])), x, y)
            touches.append(f"({near} and {side} = 0)")
    return f"(({' + '.join(crossings)}) % 2 = 1 or {' or '.join(touches)})"


PICK, DROP = ("pickup_longitude", "pickup_latitude"), ("dropoff_longitude", "dropoff_latitude")

# Statistics


def _summary(name: str, value: str, places: int, shift: float = 0.0) -> list[str]:
    parts = {"min": "min", "max": "max", "total": "sum", "avg": "avg"}
    added = {"avg": f" + {num(shift)}"} if shift else {}
    return [f"round({sql}(cast({value} as double)){added.get(part, '')}, {places}) as {name}_{part}" for part, sql in parts.items()]


def _histogram(name: str, first: int, last: int) -> list[str]:
    return [f"count(*) filter (where {name} = {b}) as {name}_{b}" for b in range(first, last + 1)]


def stats(fields=(*SUMMARIES, *HISTOGRAMS), count: bool = True, duration: bool = True, places: int = q.WHOLE_PLACES, shift: float = 0.0) -> str:
    out = ["count(*) as count"] if count else []
    for name in fields:
        out += _histogram(name, *HISTOGRAMS[name]) if name in HISTOGRAMS else _summary(name, name, places, shift)
    if duration:
        out += _summary("duration", "duration_s", places, shift)
    return ", ".join(out)


def _counted(where: str) -> str:
    return f"select {stats(['fare_amount'])} from ({VALID}) where {where}"


def _decimal(value: str) -> str:
    return f"cast(cast({value} as decimal(38,4)) as string)"


def _summary_json(value: str) -> str:
    value = f"cast({value} as double)"
    return (
        f"""'{{"min":' || {_decimal(f'min({value})')} || ',"max":' || {_decimal(f'max({value})')} || """
        f"""',"total":' || {_decimal(f'sum({value})')} || ',"avg":' || {_decimal(f'avg({value})')} || '}}'"""
    )


def _histogram_json(name: str, first: int, last: int) -> str:
    bins = " || ',' || ".join(
        f"""'"{b}":' || cast(count(*) filter (where {name} = {b}) as string)""" for b in range(first, last + 1)
    )
    return f"'{{' || {bins} || '}}'"


# Requests

KEYS = "start_lon, start_lat, dest_lon, dest_lat, start_sec"
COMPLETE = "start_lon is not null and start_lat is not null and dest_lon is not null and dest_lat is not null"
REQUESTS = f"select *, tod as start_sec, case when tod is not null then substr(start_time, 1, 19) || 'Z' end as departure from ({sample.REQUESTS})"
LEVELS = range(5)


def _near(keys_from: str, start: float, dest: float, reach: int) -> str:
    """Requests joined with the trips in their window; time cells make it a hash join."""
    step = 2 * reach
    return f"""
      (select *, unnest(range(cast(floor((start_sec - {reach}) / {step}) as bigint), cast(floor((start_sec + {reach}) / {step}) as bigint) + 1)) as c from {keys_from}) a
      join (select *, cast(floor(time_of_day_sec / {step}) as bigint) as c from v) t
      on t.c = a.c and abs(t.time_of_day_sec - a.start_sec) <= {reach}
        and pickup_longitude between start_lon - {num(start)} and start_lon + {num(start)}
        and pickup_latitude between start_lat - {num(start)} and start_lat + {num(start)}
        and dropoff_longitude between dest_lon - {num(dest)} and dest_lon + {num(dest)}
        and dropoff_latitude between dest_lat - {num(dest)} and dest_lat + {num(dest)}"""


def _answers(columns: str) -> str:
    """CTEs ending in ``answers``: the distinct requests at their first try with trips."""
    parts = [
        f"v as materialized ({VALID})",
        f"req as materialized ({REQUESTS})",
        f"ask0 as materialized (select distinct {KEYS} from req where {COMPLETE} and start_sec is not null)",
    ]
    for level in LEVELS:
        near = _near(f"ask{level}", 0.0041 * 2**level, 0.0041 * 2**level, 600 * 2**level)
        parts.append(f"m{level} as materialized (select {KEYS}, {level} as level, {columns} from {near} group by {KEYS})")
        parts.append(f"ask{level + 1} as materialized (select * from ask{level} anti join m{level} using ({KEYS}))")
    union = " union all ".join(f"select * from m{level}" for level in LEVELS)
    return "with " + ", ".join(parts) + f", answers as ({union})"


def _estimate() -> str:
    return f"""{_answers(stats(['fare_amount', 'payment_type'], places=q.REQUEST_PLACES))}
      select r.request_id, r.departure, r.start_sec, m.level is not null as matched, m.level, coalesce(m.count, 0) as count,
        coalesce(m.duration_avg, 0e0) as duration_avg, m.* exclude ({KEYS}, level, count, duration_avg)
      from req r left join answers m using ({KEYS})"""


def _card() -> str:
    columns = (
        "round(avg(trip_distance), 9) as d, round(avg(fare_amount), 9) as f, round(avg(tolls_amount), 9) as o, "
        "avg(cast(duration_s as double)) as duration_avg"
    )
    return f"""{_answers(columns)}
      select request_id, departure,
        strftime(strptime(departure, '%Y-%m-%dT%H:%M:%SZ') + to_seconds(cast(floor(duration_avg) as bigint)), '%Y-%m-%dT%H:%M:%SZ') as arrival,
        duration_avg as duration_sec, cast(round(cast(d as decimal(38,9)), 1) as double) as distance,
        cast(round(cast(f as decimal(38,9)), 2) as double) as fare,
        case when o < 1 then 0e0 else cast(round(cast(o as decimal(38,9)), 2) as double) end as tolls
      from req join answers using ({KEYS})"""


def _number_text(value: str) -> str:
    return f"case when {value} = floor({value}) then cast(cast({value} as bigint) as string) else cast({value} as string) end"


def _box_wkt(xmin: str, ymin: str, xmax: str, ymax: str) -> str:
    pairs = [(xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin)]
    return "'POLYGON ((' || " + " || ', ' || ".join(f"{_number_text(x)} || ' ' || {_number_text(y)}" for x, y in pairs) + " || '))'"


def _estimate_json() -> str:
    columns = (
        f"""'{{"count":' || cast(count(*) as string) || ',"cab_type":' || {_histogram_json('cab_type', 0, 2)} || """
        f"""',"duration":' || {_summary_json('duration_s')} || '}}' as stats, {_decimal('avg(cast(duration_s as double))')} as seconds"""
    )
    start = _box_wkt("(start_lon - b)", "(start_lat - b)", "(start_lon + b)", "(start_lat + b)")
    dest = _box_wkt("(dest_lon - b)", "(dest_lat - b)", "(dest_lon + b)", "(dest_lat + b)")
    return f"""{_answers(columns)},
      j as (select *, 0.0041e0 * pow(2, level) as b, coalesce('"' || departure || '"', 'null') as dep from req left join answers using ({KEYS}))
      select request_id, case when level is null then '[[' || dep || ',0]]' else
        '{{"durations":[[' || dep || ',' || seconds || ']],"stats":' || stats || ',"startGeom":"' || {start} || '","destGeom":"' || {dest}
        || '","startAddressInfo":{{"formatted_address":"Place ' || cast(start_lat as string) || '","address_components":[]}}'
        || case when exists (select 1 from (select distinct start_lon as x, start_lat as y from req where start_lon is not null) s where s.x = j.dest_lon and s.y = j.dest_lat)
           then ',"destAddressInfo":{{"formatted_address":"Place ' || cast(dest_lat as string) || '","address_components":[]}}' else '' end
        || '}}' end as reply
      from j"""


def _estimate_address(shown: str | None = None) -> str:
    corners = _corners(0.0, 0.0, 0.0041)
    # Corners are placed around the customer: constant offset plus position.
    sides = [
        _side(
            "pickup_longitude", "pickup_latitude",
            f"({num(a[0])} + lon)", f"({num(a[1])} + lat)", f"({num(b[0])} + lon)", f"({num(b[1])} + lat)",
        ) + " >= 0"
        for a, b in zip(corners, corners[1:], strict=False)
    ]
    box = "between s.{0} - s.half and s.{0} + s.half"
    start_box = f"pickup_longitude {box.format('lon')} and pickup_latitude {box.format('lat')}"
    dest_box = (
        "dropoff_longitude between d_lon - d_half and d_lon + d_half and dropoff_latitude between d_lat - d_half and d_lat + d_half"
    )
    level = "case " + " ".join(f"when abs(time_of_day_sec - start_sec) <= {600 * 2**k} then {k}" for k in LEVELS) + " end"
    keys = "start_address, dest_address, start_sec"
    shown = shown or stats(["fare_amount", "cab_type"], places=q.REQUEST_PLACES)
    return f"""with v as materialized ({VALID}), req as materialized ({REQUESTS}), p as materialized ({sample.PLACES}),
      pair as (select distinct start_address, dest_address from req where start_address is not null and dest_address is not null),
      located as (select pair.*, s.lon, s.lat, s.half, s.shape, d.lon as d_lon, d.lat as d_lat, d.half as d_half
        from pair join p s on s.key = start_address join p d on d.key = dest_address where s.shape in ('bounds', 'location')),
      near as materialized (select start_address, dest_address, t.* from located s join v t on {dest_box}
        and ((shape = 'bounds' and {start_box}) or (shape = 'location' and {' and '.join(sides)}))),
      ask as (select distinct {keys} from req where start_sec is not null),
      timed as materialized (select a.start_sec, n.*, {level} as level from ask a join near n using (start_address, dest_address)
        where abs(time_of_day_sec - a.start_sec) <= 9600),
      best as (select {keys}, min(level) as level from timed group by all),
      answers as (select {keys}, best.level as level, {shown} from timed join best using ({keys}) where timed.level <= best.level group by all)
      select r.request_id, r.start_sec, m.level is not null as matched, m.level, coalesce(m.count, 0) as count,
        coalesce(m.duration_avg, 0e0) as duration_avg, m.* exclude ({keys}, level, count, duration_avg)
      from req r left join answers m using ({keys})"""


def _area_match() -> str:
    corners = _corners(0.0, 0.0, 1.0)
    sides = " and ".join(
        _side(*PICK, f"(half * {num(a[0])} + x)", f"(half * {num(a[1])} + y)", f"(half * {num(b[0])} + x)", f"(half * {num(b[1])} + y)") + " >= 0"
        for a, b in zip(corners, corners[1:], strict=False)
    )
    box = "pickup_longitude between x - half and x + half and pickup_latitude between y - half and y + half"
    to_box = "dropoff_longitude between to_x - to_half and to_x + to_half and dropoff_latitude between to_y - to_half and to_y + to_half"
    return f"""with v as materialized ({VALID}), w as materialized ({sample.WINDOWS})
      select c_custkey, {stats(['passenger_count', 'cab_type'])} from w join v on {box} and {to_box}
        and time_of_day_sec between middle - reach and middle + reach and (not round or ({sides})) group by c_custkey"""


def _trip_info() -> str:
    """Each kind of request by its own way; the statistics of both are listed by name."""
    fields = ["passenger_count", "trip_distance", "fare_amount", "tip_amount", "tolls_amount", "total_amount", "vendor_id", "rate_code_id", "payment_type", "cab_type"]
    shown = stats(fields, places=q.REQUEST_PLACES, shift=q.TIE_SHIFT)
    address = "case when shape = 'empty' or street = 'no' then 'Unknown Address' when street = 'first' then key || ' Street' else 'Second ' || key end"
    mixed = f"""select *, tod as start_sec, case when tod is not null then substr(start_time, 1, 19) || 'Z' end as departure,
      case when {COMPLETE} then 'coordinates' when start_address <> '' and dest_address <> '' then 'addresses' else 'neither' end as kind
      from ({sample.MIXED.format(requests=sample.REQUESTS)})"""
    by_place = _answers(shown).replace(f"req as materialized ({REQUESTS})", f"req as materialized ({mixed})")
    by_address = _estimate_address(shown).replace(f"req as materialized ({REQUESTS})", f"req as materialized (select * from ({mixed}) where kind = 'addresses')")
    near = "exists (select 1 from places where px = {0} and py = {1})"
    return f"""with m as materialized ({mixed}), a as materialized ({by_place} select * from answers), b as materialized ({by_address}),
      known as materialized (select key, {address} as info, shape from ({sample.PLACES})),
      places as materialized (select distinct start_lon as px, start_lat as py from ({sample.REQUESTS}) where start_lon is not null),
      x as (select request_id, departure, kind, a.* exclude ({KEYS}),
          case when level is not null and {near.format('m.start_lon', 'm.start_lat')} then 'Place ' || cast(m.start_lat as string) end as start,
          case when level is not null and {near.format('m.dest_lon', 'm.dest_lat')} then 'Place ' || cast(m.dest_lat as string) end as dest
        from m left join a using ({KEYS}) where kind = 'coordinates'),
      y as (select m.request_id, m.departure, m.kind, b.* exclude (request_id, start_sec, matched),
          case when b.level is not null then s.info end as start, case when b.level is not null then d.info end as dest
        from m join b using (request_id) left join known s on s.key = m.start_address left join known d on d.key = m.dest_address),
      z as (select request_id, departure, kind from m where kind = 'neither'),
      every as (select * from x union all by name select * from y union all by name select * from z)
      select every.* exclude (departure, count, duration_avg), case when level is not null then count end as count,
        case when level is not null then duration_avg end as duration_avg, level is not null as matched,
        coalesce('"' || departure || '"', 'null') as departure,
        case when level is not null then 'POLYGON (' end as start_geom, case when level is not null then 'POLYGON (' end as dest_geom from every"""


def _in_zone(x: str, y: str) -> str:
    """Point in the zone of ``z``: corners are placed around its middle."""

    def rings(*corner_lists) -> str:
        crossings, touches = [], []
        for corners in corner_lists:
            for a, b in zip(corners, (*corners[1:], corners[0]), strict=True):
                ax, ay, bx, by = (f"({axis} + {num(v)})" for axis, v in (("z.x", a[0]), ("z.y", a[1]), ("z.x", b[0]), ("z.y", b[1])))
                side = _side(x, y, ax, ay, bx, by)
                crossings.append(f"case when ({ay} <= {y}) <> ({by} <= {y}) and ({side} > 0) = ({by} > {ay}) then 1 else 0 end")
                touches.append(f"({x} between least({ax}, {bx}) and greatest({ax}, {bx}) and {y} between least({ay}, {by}) and greatest({ay}, {by}) and {side} = 0)")
        return f"(({' + '.join(crossings)}) % 2 = 1 or {' or '.join(touches)})"

    near = f"{x} between z.x - 0.02e0 and z.x + 0.02e0 and {y} between z.y - 0.02e0 and z.y + 0.02e0"
    shell, holed, side = rings(sample.ZONE_SHELL), rings(sample.ZONE_SHELL, sample.ZONE_HOLE), rings(sample.ZONE_SIDE)
    return f"{near} and case shape when 0 then {shell} when 1 then {holed} else ({holed} or {side}) end"


def _sketch_stats() -> str:
    parts = [
        f"""select '{n}' as field, count(*) as n, count(distinct {n}) as distinct_exact, true as distinct_within, round(avg({n}), 6) as mean,
          round(var_samp({n}), 2) as variance, true as q25_within, true as q50_within, true as q75_within, true as q95_within from v"""
        for n in ("fare_amount", "trip_distance", "tip_amount", "time_of_day_sec")
    ]
    return f"with v as materialized ({VALID}) " + " union all ".join(parts)


# CSV

_VENDOR = "case when vendor in ('1', 'CMT', 'Cmt') then 1 when vendor in ('2', 'vts') then 2 else 0 end"
_PAYMENT = (
    "case when payment in ('CRD', 'Credit', '1', 'cre_dit') then 1 when payment in ('CAS', 'Cash', 'CSH') then 2 "
    "when payment in ('No Charge', 'NA', 'NOC', 'no') then 3 when payment = 'Dispute' then 4 when payment = 'UNK' then 5 "
    "when payment = 'Voided trip' then 6 when payment = '7' then 7 else 0 end"
)
_FLAG = "flag in ('Y', 'y', '1')"
_COUNT = "case passengers when '3' then 3 when '+5' then 5 when '-2' then -2 when '1' then 1 else 0 end"
_RATE = "case rate when '1' then 1 when '6' then 6 else 0 end"
_AMOUNT = (
    "case extra when ' 2.5' then '2.5' when 'NaN' then 'NaN' when '1d' then '1.0' when '-0.5' then '-0.5' "
    "when '12.25' then '12.25' else '0.0' end"
)
_LON = "case when plon in ('', 'west') then 0e0 else cast(plon as double) end"


def _parsed_time(second: str) -> str:
    return (
        f"case mode when 'blank' then null when 'roll' then cast(epoch(make_date(cast(year(day) + 1 as int), 2, 14)) as bigint) + {second} "
        f"when 'far' then cast(epoch(make_date(cast(year(day) + 10000 as int), cast(month(day) as int), cast(day(day) as int))) as bigint) + {second} "
        f"when 'long' then day_s + 1000000 + {second} "
        f"when 'minus' then cast(epoch(make_date(cast(year(day) - 1 as int), 11, 1)) as bigint) + (cast(day(day) as bigint) - 1) * 86400 + {second} "
        f"else day_s + {second} end"
    )


def _parse_trips() -> str:
    def field(value: str, where: dict[int, int], default: str) -> str:
        """Value in layouts ``{layout: position}``; lines may be cut after twelve cells."""
        there = " or ".join(f"(layout = {lay}" + (" and not cut)" if pos >= 12 else ")") for lay, pos in where.items())
        return f"case when {there} then {value} else {default} end"

    def double(column: str, where: dict[int, int]) -> str:
        return field(f"cast({column} as double)", where, "0e0")

    early = {0: 12, 1: 12, 2: 12, 3: 11}
    return f"""
      select {_VENDOR} as vendor_id, {_parsed_time('tod')} as pickup_datetime, {_parsed_time('least(tod + 600, 86399)')} as dropoff_datetime,
        {_COUNT} as passenger_count, cast(distance as double) as trip_distance,
        cast(plon as double) as pickup_longitude, cast(plat as double) as pickup_latitude,
        {_FLAG} as store_and_fwd_flag, {_RATE} as rate_code_id,
        cast(dlon as double) as dropoff_longitude, cast(dlat as double) as dropoff_latitude,
        {field(_PAYMENT, {0: 11, 1: 11, 2: 11, 3: 18}, '0')} as payment_type,
        {double('fare', early)} as fare_amount, {field(_AMOUNT, {2: 13, 3: 12}, "'0.0'")} as extra,
        {double('mta', {0: 14, 1: 14, 2: 14, 3: 13})} as mta_tax, {double('surcharge', {0: 13, 1: 13, 2: 17})} as improvement_surcharge,
        {double('tip', {0: 15, 1: 15, 2: 15, 3: 14})} as tip_amount, {double('tolls', {0: 16, 1: 16, 2: 16, 3: 15})} as tolls_amount,
        {double('total', {0: 17, 1: 17, 2: 18, 3: 17})} as total_amount, {field('2', {3: 19}, '0')} as trip_type,
        {double('ehail', {3: 16})} as ehail_fee, case mode when 'long' then mod(1000000 + tod, 86400) else tod end as time_of_day_sec,
        case layout when 3 then 2 else 1 end as cab_type
      from (select *, mod(l_partkey, 83) = 5 as cut from ({CELLS})
        where layout < 4 and mod(l_partkey, 79) <> 6 and mode <> 'blank' and plon not in ('', 'west'))"""


def _layer_trips() -> str:
    """The distinct valid trips of the parsed lines."""
    return f"""select distinct pickup_datetime as pickup_sec, dropoff_datetime as dropoff_sec, pickup_longitude, pickup_latitude,
        dropoff_longitude, dropoff_latitude from ({_parse_trips()})
        where pickup_longitude <> 0 and pickup_latitude <> 0 and dropoff_longitude <> 0 and dropoff_latitude <> 0 and time_of_day_sec <> 0"""


# Field of every header cell, in the order of the layouts of the sample lines.
_HEADER_FIELDS = (
    "vendor_id pickup_datetime dropoff_datetime passenger_count trip_distance pickup_longitude pickup_latitude rate_code_id store_and_fwd_flag "
    "dropoff_longitude dropoff_latitude payment_type fare_amount improvement_surcharge mta_tax tip_amount tolls_amount total_amount",
    "vendor_id pickup_datetime dropoff_datetime passenger_count trip_distance pickup_longitude pickup_latitude rate_code_id store_and_fwd_flag "
    "dropoff_longitude dropoff_latitude payment_type fare_amount improvement_surcharge mta_tax tip_amount tolls_amount total_amount",
    "vendor_id pickup_datetime dropoff_datetime passenger_count trip_distance pickup_longitude pickup_latitude rate_code_id store_and_fwd_flag "
    "dropoff_longitude dropoff_latitude payment_type fare_amount extra mta_tax tip_amount tolls_amount improvement_surcharge total_amount",
    "vendor_id pickup_datetime dropoff_datetime store_and_fwd_flag rate_code_id pickup_longitude pickup_latitude dropoff_longitude dropoff_latitude "
    "passenger_count trip_distance fare_amount extra mta_tax tip_amount tolls_amount ehail_fee total_amount payment_type trip_type",
    "vendor_id pickup_datetime dropoff_datetime passenger_count - fare_amount",
)


def _header_mapping() -> str:
    rows = [
        f"({i}, '{header}', {pos}, '{cell}', '{'' if field == '-' else field}')"
        for i, (header, fields) in enumerate(zip(sample.HEADERS, _HEADER_FIELDS, strict=True))
        for pos, (cell, field) in enumerate(zip(header.split(","), fields.split(), strict=True))
    ]
    return f"""select header, position, cell, field, n_lines from (values {', '.join(rows)}) h(layout, header, position, cell, field)
      join (select mod(l_orderkey, 5) as layout, count(*) as n_lines from lineitem group by 1) using (layout)"""


# Layers


def _heatmap(role: str) -> str:
    x, y = f"{role}_longitude", f"{role}_latitude"
    step_x, step_y = (-73.575 - -74.375) / 256, (41.1 - 40.3) / 256
    kernel = ", ".join(
        f"({i - 2}, {j - 2}, {a * b})" for i, a in enumerate((1, 4, 6, 4, 1)) for j, b in enumerate((1, 4, 6, 4, 1))
    )
    return f"""with c as (select least(cast(floor(({x} - -74.375e0) / {num(step_x)}) as bigint), 255) as x,
          least(cast(floor(({y} - 40.3e0) / {num(step_y)}) as bigint), 255) as y, count(*) as n
        from ({VALID}) where {_in_box((-74.375, 40.3, -73.575, 41.1), x, y)} group by 1, 2)
      select c.x + dx as x, c.y + dy as y, cast(sum(n * w) as double) / 256e0 as density from c, (values {kernel}) k(dx, dy, w)
      where c.x + dx between 0 and 255 and c.y + dy between 0 and 255 group by 1, 2"""


def _heatmap_tiles() -> str:
    x, y = PICK
    step_x, step_y = (-73.575 - -74.375) / 256, (41.1 - 40.3) / 256
    kernel = ", ".join(f"({i - 2}, {j - 2}, {a * b})" for i, a in enumerate((1, 4, 6, 4, 1)) for j, b in enumerate((1, 4, 6, 4, 1)))
    return f"""with f as (select least(cast(floor(({x} - -74.375e0) / {num(step_x)}) as bigint), 255) as x,
          least(cast(floor(({y} - 40.3e0) / {num(step_y)}) as bigint), 255) as y, count(*) as n
        from ({VALID}) where {_in_box((-74.375, 40.3, -73.575, 41.1), x, y)} group by 1, 2),
      c as (select z.zoom, x >> (8 - z.zoom) as x, y >> (8 - z.zoom) as y, sum(n) as n from f, (values (8), (7), (6), (5), (4), (3)) z(zoom) group by all),
      s as (select zoom, c.x + dx as x, c.y + dy as y, cast(sum(n * w) as double) / 256e0 as density from c, (values {kernel}) k(dx, dy, w)
        where c.x + dx between 0 and (1 << zoom) - 1 and c.y + dy between 0 and (1 << zoom) - 1 group by all)
      select zoom, x >> 4 as tile_x, y >> 4 as tile_y, x, y, density from s"""


def _point_tiles() -> str:
    x, y = DROP
    step_x, step_y = (-73.575 - -74.375) / 64, (41.1 - 40.3) / 64
    return f"""with f as (select least(cast(floor(({x} - -74.375e0) / {num(step_x)}) as bigint), 63) as tx,
          least(cast(floor(({y} - 40.3e0) / {num(step_y)}) as bigint), 63) as ty, {x} as x, {y} as y, dropoff_s as time, md5({_trip_id()}) as o
        from ({VALID}) where {_in_box((-74.375, 40.3, -73.575, 41.1), x, y)})
      select zoom, tx >> (6 - zoom) as tile_x, ty >> (6 - zoom) as tile_y, count(*) over (partition by zoom, tx >> (6 - zoom), ty >> (6 - zoom)) as n_points, x, y, time
      from f, (values (6), (5), (4), (3), (2), (1)) z(zoom)
      qualify row_number() over (partition by zoom, tx >> (6 - zoom), ty >> (6 - zoom) order by o, x, y, time) <= 40"""


def _address_cache() -> str:
    address = "case when shape = 'empty' or street = 'no' then 'Unknown Address' when street = 'first' then key || ' Street' else 'Second ' || key end"
    return f"""with r as materialized (select request_id, start_address, dest_address from ({sample.REQUESTS})),
      k as materialized (select key, {address} as info, lon - case shape when 'location' then 0.0041e0 when 'bounds' then half end as xmin from ({sample.PLACES})),
      u as (select request_id, start_address as key from r union all select request_id, dest_address from r),
      first as materialized (select distinct key from u where mod(request_id, 2) = 0 and key is not null),
      every as materialized (select distinct key from u where key is not null),
      loads as (select 10 as load, (select count(*) from first) as asked, 0 as kept, (select count(*) from first join k using (key)) as parsed
        union all select 25, (select count(*) from every), (select count(*) from every join k using (key) where key in (select key from first)),
          (select count(*) from every join k using (key) where key not in (select key from first))
        union all select 100, (select count(*) from every), 0, (select count(*) from every join k using (key)))
      select load, cast(asked as bigint) as asked, cast(kept as bigint) as kept, cast(parsed as bigint) as parsed,
        case when s.key is null then null when load = 25 and s.key in (select key from first) then 15 else 0 end as start_age, s.info as start, d.xmin as dest_xmin, count(*) as n
      from loads join r on load > 10 or mod(request_id, 2) = 0 left join k s on s.key = start_address left join k d on d.key = dest_address group by all"""


def _layer_merge_read() -> str:
    places = ", ".join(PICK + DROP)
    loads = ["true", "mod(l_orderkey, 2) = 0", "mod(l_orderkey, 3) = 0", "mod(l_orderkey, 7) = 0 and pickup_longitude < -74.0e0"]
    rows = " union all ".join(f"select {i} as load, pickup_s, dropoff_s, time_of_day_sec, {places} from v where {where}" for i, where in enumerate(loads))
    group = f"pickup_s, dropoff_s, time_of_day_sec, {places}"
    states = {
        "merged": ("true", "true"), "compacted": ("true", "true"), "second": ("load < 2", "true"), "compacted second": ("load < 2", "true"),
        "area": ("true", f"{_WINDOW} and {_in_box(q.BOX_A, *PICK)}"),
    }
    return f"with v as materialized ({VALID}), l as materialized ({rows}) " + " union all ".join(
        f"""select cast(load as int) as passenger_count, count(*) as n, cast(sum(pickup_s) as bigint) as pickup_sum, '{state}' as state
          from (select {group}, max(load) as load from l where {loads_} and {where} group by all) group by load"""
        for state, (loads_, where) in states.items()
    )


def _points(role: str) -> str:
    x, y = f"{role}_longitude", f"{role}_latitude"
    return f"select '{role}' as role, {x} as x, {y} as y, {role}_s as time from ({VALID}) where {_in_box(q.BOX_A, x, y)}"


def _period(role: str) -> str:
    x, y = f"{role}_longitude", f"{role}_latitude"
    start, end = (int((t - type(t)(1970, 1, 1)).total_seconds()) for t in q.PERIOD)
    return f"select {stats(['fare_amount'])}, '{role}' as role from ({VALID}) where {role}_s between {start} and {end} and {_in_box(q.BOX_A, x, y)}"


_POLYGONS = """select c_custkey, c_name,
  case mod(c_custkey, 5) when 0 then 'Manhattan' when 1 then 'Bronx' when 2 then 'Brooklyn' when 3 then 'Queens' else 'Staten Island' end as borough,
  -74.03e0 + mod(c_custkey * 37, 1000) / 10000e0 as x, 40.70e0 + mod(c_custkey * 59, 1000) / 10000e0 as y from customer"""
_SQUARE = "[[x, y], [x + 0.01e0, y], [x + 0.01e0, y + 0.01e0], [x, y + 0.01e0], [x, y]]"
_TRIANGLE = "[[x + 0.5e0, y], [x + 0.51e0, y], [x + 0.51e0, y + 0.01e0], [x + 0.5e0, y]]"
_PARTS = f"""select c_custkey, c_name as name, borough, 0 as part, {_SQUARE} as ring from ({_POLYGONS})
  union all select c_custkey, '', borough, 0, {_SQUARE} from ({_POLYGONS}) where mod(c_custkey, 3) = 0
  union all select c_custkey, '', borough, 1, {_TRIANGLE} from ({_POLYGONS}) where mod(c_custkey, 3) = 0"""


def _features(role: str) -> str:
    names = list(LAYER_COLUMNS)
    if role == "dropoff":
        names[7], names[12] = names[12], names[7]
    plain = {
        "pickup_datetime": "pickup_s as pickup_datetime",
        "dropoff_datetime": "dropoff_s as dropoff_datetime",
        "pickup_location": "pickup_longitude as pickup_location_x, pickup_latitude as pickup_location_y",
        "dropoff_location": "dropoff_longitude as dropoff_location_x, dropoff_latitude as dropoff_location_y",
        "ehail_fee": "cast(trunc(ehail_fee) as int) as ehail_fee",
    }
    columns = ", ".join(plain.get(n, n) for n in names)
    return f"select {_trip_id()} as trip_id, {columns}, '{','.join(names)}' as attributes from ({VALID})"


def _trip_id() -> str:
    def place(x: str, y: str) -> str:
        return f"'POINT (' || {_number_text(x)} || ' ' || {_number_text(y)} || ')_'"

    times = "cast(pickup_s * 1000 as string) || '_' || cast(dropoff_s * 1000 as string) || '_'"
    return f"{times} || {place(*PICK)} || {place(*DROP)}"


def _grid(bias: str, space: int, time: int) -> str:
    def cell(value: str, low: float, high: float, bits: int) -> str:
        clamped = f"least(greatest(cast({value} as double), {num(low)}), {num(high)})"
        return f"least(cast(floor(({clamped} - {num(low)}) / {num(high - low)} * {num(2**bits)}) as bigint), {2**bits - 1})"

    lon, lat = (-74.375, -73.575), (40.3, 41.1)
    return f"""select {IDS}, '{bias}' as bias, {cell(PICK[0], *lon, space)} as pickup_x, {cell(PICK[1], *lat, space)} as pickup_y,
      {cell(DROP[0], *lon, space)} as dropoff_x, {cell(DROP[1], *lat, space)} as dropoff_y, {cell('time_of_day_sec', 0.0, 86400.0, time)} as time_cell
      from ({TRIPS})"""


def _circle_polygon() -> str:
    corners = ", ".join(f"({i}, {num(x)}, {num(y)})" for i, (x, y) in enumerate(_corners(0.0, 0.0, 0.0041)))
    return f"select key, corner, dx + lon as x, dy + lat as y from ({sample.PLACES}), (values {corners}) c(corner, dx, dy)"


_WINDOW = f"time_of_day_sec between {q.WINDOW[0]} and {q.WINDOW[1]}"


def oracle_sql() -> dict[str, str]:
    flagship = f"{_WINDOW} and {_in_circle(q.CIRCLE, *PICK)} and {_in_box(q.BOX_B, *DROP)}"
    circles = f"time_of_day_sec between 1 and 500 and {_in_circle(q.START_CIRCLE, *PICK)} and {_in_circle(q.DEST_CIRCLE, *DROP)}"
    boxes = f"{_WINDOW} and {_in_box(q.BOX_A, *PICK)} and {_in_box(q.BOX_B, *DROP)}"
    multi = (
        f"({_in_box(q.PART_A, *PICK)} or {_in_polygon([q.TRIANGLE], *PICK)}) and "
        f"({_in_box(q.BOX_B, *DROP)} or {_in_box(q.PART_B, *DROP)})"
    )
    placed = f"select *, case shape when 'location' then 0.0041e0 when 'bounds' then half end as r from ({sample.PLACES})"
    around = [f"{_number_text(f'({num(x)} + lon)')} || ' ' || {_number_text(f'({num(y)} + lat)')}" for x, y in _corners(0.0, 0.0, 0.0041)]
    circle_wkt = "'POLYGON ((' || " + " || ', ' || ".join(around) + " || '))'"
    address = "case when shape = 'empty' or street = 'no' then 'Unknown Address' when street = 'first' then key || ' Street' else 'Second ' || key end"
    out = {
        "trip_query": f"select {stats()} from ({VALID}) where {flagship}",
        "trip_query_circles": f"select {stats([])} from ({VALID}) where {circles}",
        "trip_stats": f"select {stats()} from ({VALID})",
        "minmaxtot_stats": f"select {stats(SUMMARIES, count=False, duration=False)} from ({TRIPS})",
        "int_histogram": f"select {stats(HISTOGRAMS, count=False, duration=False)} from ({TRIPS})",
        "duration_stats": f"select {stats([])} from ({TRIPS})",
        "selected_stats": f"select {stats(['tip_amount', 'cab_type'])} from ({VALID})",
        "merged_stats": f"select {stats()} from ({VALID})",
        "stats_json": (
            f"""select '{{"count":' || cast(count(*) as string) || ',"fare_amount":' || {_summary_json('fare_amount')} || ',"tolls_amount":' || """
            f"""{_summary_json('tolls_amount')} || ',"cab_type":' || {_histogram_json('cab_type', 0, 2)} || ',"duration":' || {_summary_json('duration_s')} """
            f"|| '}}' as stats from ({VALID})"
        ),
        "valid_trips": f"select {IDS}, pickup_longitude, pickup_latitude, time_of_day_sec from ({VALID})",
        "time_filter": _counted(_WINDOW),
        "box_filter": _counted(_in_box(q.BOX_A, *PICK)),
        "trip_filter": f"select {IDS}, time_of_day_sec, fare_amount from ({VALID}) where {boxes}",
        "circle_filter": _counted(_in_circle(q.CIRCLE, *PICK)),
        "polygon_filter": _counted(_in_polygon([q.SHELL, q.HOLE], *PICK)),
        "multi_area_filter": _counted(multi),
        "spatiotemporal_filter": f"{_period('pickup')} union all {_period('dropoff')}",
        "feature_scan": f"select {_trip_id()} as trip_id, vendor_id, fare_amount, time_of_day_sec from ({VALID}) where {flagship}",
        "features_pickup": _features("pickup"),
        "features_dropoff": _features("dropoff"),
        "trip_id": f"select {IDS}, {_trip_id()} as trip_id from ({VALID})",
        "trip_duration": f"select {IDS}, duration_s as duration_sec from ({TRIPS})",
        "time_of_day": f"select {IDS}, time_of_day_sec, mod(dropoff_s, 86400) as dropoff_sec from ({TRIPS})",
        "dedup_trips": f"""with t as ({TRIPS}), u as (
            select {IDS}, pickup_s, dropoff_s, {', '.join(PICK + DROP)}, 1 as ingest_seq, fare_amount from t union all
            select {IDS}, pickup_s, dropoff_s, {', '.join(PICK + DROP)}, 2, fare_amount + 1e0 from t where mod(l_orderkey, 50) = 0)
          select {IDS}, ingest_seq, round(fare_amount, 6) as fare_amount from u qualify row_number() over (
            partition by pickup_s, dropoff_s, {', '.join(PICK + DROP)} order by ingest_seq desc) = 1""",
        "search_box": f"""select request_id, start_lon - 0.0041e0 as xmin, start_lat - 0.0041e0 as ymin, start_lon + 0.0041e0 as xmax,
          start_lat + 0.0041e0 as ymax, {_box_wkt('(start_lon - 0.0041e0)', '(start_lat - 0.0041e0)', '(start_lon + 0.0041e0)', '(start_lat + 0.0041e0)')} as wkt
          from ({sample.REQUESTS}) where start_lon is not null""",
        "circle_polygon": _circle_polygon(),
        "shape_envelope": f"""select c_custkey, name, part, list_min([p[1] for p in ring]) as xmin, list_min([p[2] for p in ring]) as ymin,
          list_max([p[1] for p in ring]) as xmax, list_max([p[2] for p in ring]) as ymax from ({_PARTS})""",
        "polygon_layer": f"""select c_custkey, name, borough, part, 0 as ring, i - 1 as corner, points[i][1] as x, points[i][2] as y
          from (select c_custkey, name, borough, part, ring as points, unnest(range(1, len(ring) + 1)) as i from ({_PARTS}))""",
        "grid_cell": " union all ".join([_grid("temporal", 7, 34), _grid("balanced", 12, 12), _grid("spatial", 14, 6)]),
        "requests_match": f"""with v as materialized ({VALID}), req as ({REQUESTS}),
          ask as materialized (select distinct {KEYS} from req where {COMPLETE} and start_sec is not null)
          select {KEYS}, {stats(['tip_amount'], places=q.REQUEST_PLACES)} from {_near('ask', 0.0123, 0.0082, 1500)} group by {KEYS}""",
        "area_match": _area_match(),
        "estimate": _estimate(),
        "trip_card": _card(),
        "estimate_address": _estimate_address(),
        "estimate_json": _estimate_json(),
        "departures": f"select request_id, departure, start_sec from ({REQUESTS})",
        "geocode_area": f"""select key, lon - r as xmin, lat - r as ymin, lon + r as xmax, lat + r as ymax,
          case shape when 'location' then 0.0041e0 end as radius, case shape when 'location' then {circle_wkt}
            when 'bounds' then {_box_wkt('(lon - r)', '(lat - r)', '(lon + r)', '(lat + r)')} end as wkt from ({placed})""",
        "geocode_address": f"""select key, {address} as address,
          case when shape <> 'empty' and street = 'first' then 1 else 0 end as components from ({sample.PLACES})""",
        "address_lookup": f"""with p as (select *, {address} as address from ({placed})) select request_id, s.address as start, d.address as dest, d.lon - d.r as dest_xmin
          from ({sample.REQUESTS}) left join p s on s.key = start_address left join p d on d.key = dest_address""",
        "trip_info": _trip_info(),
        "address_cache": _address_cache(),
        "trips_by_borough": f"""with v as materialized ({VALID}) select borough, 'Zone ' || s_suppkey as zone, {stats(['passenger_count', 'payment_type'])}
          from ({sample.ZONES}) z join v on {_in_zone(*PICK)} group by borough, s_suppkey""",
        "trips_in_zones": f"with v as materialized ({VALID}) select {IDS}, borough, 'Zone ' || s_suppkey as zone from ({sample.ZONES}) z join v on {_in_zone(*DROP)}",
        "sketch_stats": _sketch_stats(),
        "heatmap_tiles": _heatmap_tiles(),
        "point_tiles": _point_tiles(),
        "layer_merge_read": _layer_merge_read(),
        "heatmap_pickup": _heatmap("pickup"),
        "heatmap_dropoff": _heatmap("dropoff"),
        "point_layer": f"{_points('pickup')} union all {_points('dropoff')}",
        "parse_trips": _parse_trips(),
        "header_mapping": _header_mapping(),
        "csv_to_layer": f"""select cast(floor(mod(pickup_sec, 86400) / 3600) as int) as hour, role, count(*) as n,
          cast(sum(dropoff_sec - pickup_sec) as bigint) as seconds
          from ({_layer_trips()}) cross join (values ('pickup'), ('dropoff')) r(role) group by all""",
        "stored_layer_scan": f"""select * from ({_layer_trips()}) where mod(pickup_sec, 86400) between {q.WINDOW[0]} and {q.WINDOW[1]}
          and {_in_box(q.BOX_A, *PICK)} and {_in_box(q.BOX_B, *DROP)}""",
        "stored_trip_query": f"""select count(*) as count, {', '.join(_summary('duration', '(dropoff_sec - pickup_sec)', 6))}
          from ({_layer_trips()}) where mod(pickup_sec, 86400) between {q.WINDOW[0]} and {q.WINDOW[1]} and {_in_circle(q.CIRCLE, *PICK)}""",
        "upsert_layer": f"""select fresh, count(*) as n, cast(sum(pickup_s) as bigint) as pickup_sum, cast(sum(dropoff_s) as bigint) as dropoff_sum
          from (select pickup_s, dropoff_s, pickup_longitude, pickup_latitude, dropoff_longitude, dropoff_latitude,
            bool_or(mod(l_orderkey, 2) = 0 or mod(l_orderkey, 3) = 0) as fresh from ({VALID})
            group by 1, 2, 3, 4, 5, 6) group by fresh""",
        "parse_datetime": f"select {IDS}, mode, {_parsed_time('tod')} as pickup_sec from ({CELLS})",
        "parse_numbers": f"select {IDS}, {_COUNT} as passengers, {_RATE} as rate, {_AMOUNT} as extra, {_LON} as lon from ({CELLS})",
        "norm_vendor": f"select {IDS}, {_VENDOR} as vendor_id from ({CELLS})",
        "norm_flag": f"select {IDS}, {_FLAG} as flag from ({CELLS})",
        "norm_payment": f"select {IDS}, {_PAYMENT} as payment_type from ({CELLS})",
        "cab_type": """select file_name, cab_type, count(*) as n from (select mod(l_orderkey, 5) as layout from lineitem) join (values
          (0, 'yellow_tripdata_2009-01.csv', 1), (1, 'Yellow_tripdata_2012-05.csv', 1), (2, 'yellow_green_2015-02.csv', 1),
          (3, 'green_tripdata_2013-08.csv', 2), (4, 'other_2017-01.csv', 0)) f(layout, file_name, cab_type) using (layout) group by 1, 2""",
    }
    # The same results by plans that are forced.
    return out | {name: out[of] for name, of in {"trips_by_borough_shuffled": "trips_by_borough", "requests_match_crowded": "requests_match", "area_match_sampled": "area_match", "estimate_shuffled": "estimate", "address_lookup_large": "address_lookup"}.items()}
