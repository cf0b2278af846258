"""Chemical elements: symbols, masses and electronegativities."""

# Element symbols in order of atomic number.
SYMBOLS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr "
    "Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu "
    "Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr "
    "Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()

# Standard atomic weights (u) of the elements 1 to 103, from public tables.
MASSES = dict(zip(SYMBOLS, map(float, (
    "1.00794 4.002602 6.941 9.012182 10.811 12.0107 14.0067 15.9994 18.9984032 20.1797 22.98976928 24.305 26.9815386 "
    "28.0855 30.973762 32.065 35.453 39.948 39.0983 40.078 44.955912 47.867 50.9415 51.9961 54.938045 55.845 58.933195 "
    "58.6934 63.546 65.409 69.723 72.64 74.9216 78.96 79.904 83.798 85.4678 87.62 88.90585 91.224 92.90638 95.94 98 "
    "101.07 102.9055 106.42 107.8682 112.411 114.818 118.71 121.76 127.6 126.90447 131.293 132.9054519 137.327 138.90547 "
    "140.116 140.90765 144.242 145 150.36 151.964 157.25 158.92535 162.5 164.93032 167.259 168.93421 173.04 174.967 "
    "178.49 180.94788 183.84 186.207 190.23 192.217 195.084 196.966569 200.59 204.3833 207.2 208.9804 210 210 220 223 "
    "226 227 232.03806 231.03588 238.02891 237 244 243 247 247 251 252 257 258 259 262"
).split())))

# Pauling electronegativities of the elements 1 to 103 (0 where none is given).
ELECTRONEGATIVITY = dict(zip(SYMBOLS, map(float, (
    "2.2 0 0.98 1.57 2.04 2.55 3.04 3.44 3.98 0 0.93 1.31 1.61 1.9 2.19 2.58 3.16 0 0.82 1 1.36 1.54 1.63 1.66 1.55 "
    "1.83 1.88 1.91 1.9 1.65 1.81 2.01 2.18 2.55 2.96 3 0.82 0.95 1.22 1.33 1.6 2.16 1.9 2.2 2.28 2.2 1.93 1.69 1.78 "
    "1.96 2.05 2.1 2.66 2.6 0.79 0.89 1.1 1.12 1.13 1.14 1.13 1.17 1.2 1.2 1.1 1.22 1.23 1.24 1.25 1.1 1.27 1.3 1.5 "
    "2.36 1.9 2.2 2.2 2.28 2.54 2 1.62 2.33 2.02 2 2.2 0 0.7 0.9 1.1 1.3 1.5 1.38 1.36 1.28 1.3 1.3 1.3 1.3 1.3 1.3 "
    "1.3 1.3 1.3"
).split())))

# Empirical atomic radii in angstrom, of the elements that have one.
RADIUS = {s: float(r) for s, r in (pair.split(":") for pair in (
    "H:0.25 Li:1.45 Be:1.05 B:0.85 C:0.7 N:0.65 O:0.6 F:0.5 Na:1.8 Mg:1.5 Al:1.25 Si:1.1 P:1.0 S:1.0 Cl:1.0 K:2.2 Ca:1.8 "
    "Sc:1.6 Ti:1.4 V:1.35 Cr:1.4 Mn:1.4 Fe:1.4 Co:1.35 Ni:1.35 Cu:1.35 Zn:1.35 Ga:1.3 Ge:1.25 As:1.15 Se:1.15 Br:1.15 "
    "Rb:2.35 Sr:2.0 Y:1.8 Zr:1.55 Nb:1.45 Mo:1.45 Tc:1.35 Ru:1.3 Rh:1.35 Pd:1.4 Ag:1.6 Cd:1.55 In:1.55 Sn:1.45 Sb:1.45 Te:1.4 I:1.4 "
    "Cs:2.6 Ba:2.15 La:1.95 Ce:1.85 Pr:1.85 Nd:1.85 Pm:1.85 Sm:1.85 Eu:1.85 Gd:1.8 Tb:1.75 Dy:1.75 Ho:1.75 Er:1.75 Tm:1.75 Yb:1.75 Lu:1.75 "
    "Hf:1.55 Ta:1.45 W:1.35 Re:1.35 Os:1.3 Ir:1.35 Pt:1.35 Au:1.35 Hg:1.5 Tl:1.9 Pb:1.8 Bi:1.6 Po:1.9 Ra:2.15 Ac:1.95 Th:1.8 Pa:1.8 U:1.75 Np:1.75 Pu:1.75 Am:1.75"
).split())}

KNOWN = frozenset(SYMBOLS)
NUMBER = {s: i + 1 for i, s in enumerate(SYMBOLS)}


def group_of(symbol: str) -> int:
    """Group (column) of the periodic table, 3 for the f block."""
    z = NUMBER[symbol]
    if z == 1:
        return 1
    if z == 2:
        return 18
    for start, period in ((3, 8), (11, 8), (19, 18), (37, 18), (55, 32), (87, 32)):
        if start <= z < start + period:
            at = z - start
            if period == 8:
                return at + 1 if at < 2 else at + 11
            if period == 18:
                return at + 1
            return at + 1 if at < 2 else max(3, at - 13)
    raise ValueError(symbol)
