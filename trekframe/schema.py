"""The tables of the engine.  Absent is null, never 0; order in a track is (segment_idx, point_idx), never time."""

POINTS = (
    "track_id string, segment_idx int, point_idx int, lat double, lon double, ele double, time_ms long, hacc_m double"
)
WAYPOINTS = "track_id string, wpt_idx int, name string, lat double, lon double, ele double, time_ms long"
GPX_FILES, GPX_CONTENTS = "path string, xml string", "path string, content binary"
DEM_TILES = "zoom int, x int, y int, pixels array<int>"
ROUTES = (
    "id string, name string, created_at_ms long, distance_m double, gain_m double, loss_m double, point_count long, "
    "difficulty string, walking_s double"
)
