"""Codes of particles, cells, nodes and edges."""

NOT_RELEASED, DEAD, OUTSIDE_DOMAIN, OUTSIDE_OPEN = -10, -5, -2, -1
STATIONARY, STRANDED, ON_BOTTOM, MOVING = 0, 3, 6, 10
#: From this status on a particle is alive.
ALIVE = OUTSIDE_OPEN

CELL_OK, HIT_DOMAIN, HIT_OPEN, HIT_DRY, BAD_COORD, FAILED = 0, -1, -2, -3, -20, -30
INTERIOR_NODE, ISLAND_NODE, DOMAIN_NODE, OPEN_NODE, LAND_NODE = 0, 1, 2, 3, 4
INTERIOR_EDGE, DOMAIN_EDGE, OPEN_EDGE = 0, -1, -2
