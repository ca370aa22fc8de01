"""DuckDB SQL over the given tables that the oracles share: the derived drawings, and plane geometry as SQL text."""

from __future__ import annotations

GAPS = "[180,250,320,340,450,700]"


def entities(revised: bool = False, name: str = "ent") -> str:
    """CTEs <name>: one row an entity with its box, ends of two-point lines (ax..ye), circle and height fields."""
    gap = f"{GAPS}[(c%6+1)::int]" + (" + CASE WHEN k%10=3 THEN 60 ELSE 0 END" if revised else "")
    keep = "WHERE o_orderkey%50<>7" if revised else ""
    line = "SELECT k,{slot} slot,'{layer}' layer,'{kind}' entity_type,'polyline' kind,{ax}::double ax,{ay}::double ay,{bx}::double bx,{ye}::double ye,NULL::double cx,NULL::double cy,NULL::double radius,false closed,NULL::varchar txt,{zk} z_known,{z}::double z FROM {n}_b{where}"
    rect = "SELECT k,{slot},'{layer}','LWPOLYLINE','polyline',{ax}::double,{ay}::double,{bx}::double,{ye}::double,NULL,NULL,NULL,true,NULL,false,NULL FROM {n}_b{where}"
    n = f"{name}"
    parts = [
        line.format(slot=0, layer="SCADA-CABLE", kind="LWPOLYLINE", ax="cx+200", ay="cy+1000", bx="x1", ye="cy+1000+tilt", zk="k%2=0", z="CASE WHEN k%2=0 THEN 1000 END", n=n, where=""),
        line.format(slot=1, layer="POWER-CABLE", kind="LWPOLYLINE", ax="cx+200", ay="cy+1000+gap", bx="x1", ye="cy+1000+gap", zk="false", z="NULL", n=n, where=""),
        f"SELECT k,2,'SUPPORT','CIRCLE','circle',NULL,NULL,NULL,NULL,cx+300+(k*31+c*17)%5200,cy+300+(k*13+c*7)%2200,90,false,NULL,false,NULL FROM {n}_b",
        f"SELECT k,3,'SUPPORT','CIRCLE','circle',NULL,NULL,NULL,NULL,cx+300+(k*57+c*29)%5200,cy+300+(k*23+c*11)%2200,90,false,NULL,false,NULL FROM {n}_b",
        line.format(slot=4, layer="WATER", kind="LINE", ax="cx+1500+k*53%2500", ay="cy+300", bx="cx+1500+k*53%2500", ye="cy+2600", zk="false", z="NULL", n=n, where=" WHERE k%3=0"),
        line.format(slot=5, layer="POWER-CROSS", kind="LINE", ax="cx+1200", ay="cy+700", bx="cx+1200", ye="cy+1300", zk="k%2=0", z="CASE WHEN k%2=0 THEN 1100+50*(c%5) END", n=n, where=" WHERE k%9=0"),
        rect.format(slot=6, layer="TRENCH", ax="cx+100", ay="cy+900", bx="cx+5000", ye="cy+1100", n=n, where=" WHERE k%10=0"),
        rect.format(slot=7, layer="NOGO", ax="cx+2000", ay="cy+800", bx="cx+2600", ye="cy+1400", n=n, where=" WHERE k%20=5"),
        f"SELECT k,8,'NOTE','TEXT','text',NULL,NULL,NULL,NULL,cx+500,cy+1100,NULL,false,'SCADA '||k,false,NULL FROM {n}_b WHERE k%11=0",
        line.format(slot=9, layer="SCADA-CABLE", kind="LINE", ax="x1", ay="cy+1000+tilt", bx="x1", ye="cy+500", zk="false", z="NULL", n=n, where=" WHERE k%4=0"),
    ]
    return f"""{n}_a AS (SELECT o_orderkey k, o_custkey c, o_orderkey%128*6000 cx, (o_orderkey//128)*6000 cy FROM orders {keep}),
{n}_b AS (SELECT *, {gap} gap, CASE WHEN c%5=4 THEN 8 ELSE 0 END tilt, cx+2500+(k*7919+c)%2300 x1 FROM {n}_a),
{n}_c AS ({" UNION ALL ".join(parts)}),
{n} AS (SELECT 'dwg-'||(k//1024) drawing_key, k*16+slot seq, printf('%X', k*16+slot) handle, 'dwg-'||(k//1024)||'#'||printf('%X', k*16+slot) eid, *,
 CASE kind WHEN 'polyline' THEN least(ax,bx) WHEN 'circle' THEN cx-radius ELSE cx END minx,
 CASE kind WHEN 'polyline' THEN least(ay,ye) WHEN 'circle' THEN cy-radius ELSE cy END miny,
 CASE kind WHEN 'polyline' THEN greatest(ax,bx) WHEN 'circle' THEN cx+radius ELSE cx+greatest(length(txt),1)*100*0.6 END maxx,
 CASE kind WHEN 'polyline' THEN greatest(ay,ye) WHEN 'circle' THEN cy+radius ELSE cy+100 END maxy,
 CASE WHEN layer LIKE 'SCADA%' THEN 'SCADA' WHEN layer LIKE 'POWER%' THEN 'POWER' WHEN layer LIKE 'SUPPORT%' THEN 'SUPPORT' END system,
 CASE WHEN (k//1024)%5=3 THEN 10.0::double ELSE 1.0::double END unit_to_mm, (k//1024)%7=2 units_assumed
 FROM {n}_c)"""


def point_segment(px, py, ax, ay, bx, ye) -> str:
    l2 = f"(({bx}-{ax})*({bx}-{ax})+({ye}-{ay})*({ye}-{ay}))"
    t = f"least(1.0,greatest(0.0,(({px}-{ax})*({bx}-{ax})+({py}-{ay})*({ye}-{ay}))/nullif({l2},0)))"
    return f"sqrt(pow({px}-({ax}+coalesce({t},0)*({bx}-{ax})),2)+pow({py}-({ay}+coalesce({t},0)*({ye}-{ay})),2))"


def crosses(s="s", t="t") -> str:
    """Two segments share a point (the derived drawings have integer coordinates, so no tolerance is needed)."""

    def turn(a, b, c):
        return f"(({b[0]}-{a[0]})*({c[1]}-{a[1]})-({b[1]}-{a[1]})*({c[0]}-{a[0]}))"

    a, b, c, d = ((f"{s}.ax", f"{s}.ay"), (f"{s}.bx", f"{s}.ye"), (f"{t}.ax", f"{t}.ay"), (f"{t}.bx", f"{t}.ye"))
    o1, o2, o3, o4 = turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)
    boxes = f"{s}.minx<={t}.maxx AND {t}.minx<={s}.maxx AND {s}.miny<={t}.maxy AND {t}.miny<={s}.maxy"
    return f"({boxes} AND {o1}*{o2}<=0 AND {o3}*{o4}<=0)"


def line_line(s="s", t="t") -> str:
    ends = [point_segment(f"{p}.{e}x", f"{p}.{y}", f"{q}.ax", f"{q}.ay", f"{q}.bx", f"{q}.ye") for p, q in ((s, t), (t, s)) for e, y in (("a", "ay"), ("b", "ye"))]
    return f"(CASE WHEN {crosses(s, t)} THEN 0 ELSE least({','.join(ends)}) END)"


def line_circle(s="s", t="t") -> str:
    """Distance of line s to the rim of circle t, 0 if the line has an end inside or crosses it (a disc holds its inside)."""
    d = point_segment(f"{t}.cx", f"{t}.cy", f"{s}.ax", f"{s}.ay", f"{s}.bx", f"{s}.ye")
    return f"greatest(0.0,{d}-{t}.radius)"


def classify(v: str, op: str, value: float, severity: str = "FAIL", margin: float = 0) -> str:
    ok = {">=": f"{v}>={value}-1e-6", "<=": f"{v}<={value}+1e-6", "==": f"abs({v}-({value}))<=1e-6"}[op]
    warn = f" WHEN {v}<{value}+{margin}-1e-6 THEN 'WARNING'" if margin and op == ">=" else ""
    return f"CASE WHEN NOT ({ok}) THEN '{severity}'{warn} ELSE 'PASS' END"
