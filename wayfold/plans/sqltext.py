"""Small pieces of SQL text shared by the SQL twins of the registered queries."""


def km(a: str, b: str, c: str, d: str) -> str:
    """Great-circle km between (a, b) and (c, d)."""
    h = (
        f"(power(sin(radians(({c})-({a}))/2e0),2) + cos(radians({a}))*cos(radians({c}))"
        f"*power(sin(radians(({d})-({b}))/2e0),2))"
    )
    return f"(2e0*6371e0*atan2(sqrt(least(1e0,greatest(0e0,{h}))), sqrt(1e0-least(1e0,greatest(0e0,{h})))))"


def leg_km(plat, plon, alat, alon, blat, blon, lat0) -> str:
    """Distance of a point to a leg on the local plane at latitude lat0."""
    kx = f"(cos(radians({lat0}))*111e0)"
    dx, dy = f"(({blon})-({alon}))*{kx}", f"(({blat})-({alat}))*111e0"
    l2 = f"(({dx})*({dx})+({dy})*({dy}))"
    t = (
        f"(CASE WHEN {l2}=0 THEN 0e0 ELSE greatest(0e0, least(1e0, ((({plon})-({alon}))*{kx}*({dx})"
        f"+(({plat})-({alat}))*111e0*({dy}))/{l2})) END)"
    )
    x = f"((({plon})-({alon}))*{kx}-{t}*({dx}))"
    y = f"((({plat})-({alat}))*111e0-{t}*({dy}))"
    return f"sqrt({x}*{x}+{y}*{y})"


def bankers(x: str) -> str:
    return f"round_even({x}, 0)"
