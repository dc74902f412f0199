from .checks import (flags_ok, ip_ok, payload_ok, port_ok, profile_ok,
                     profile_names, register_profile)
from .packet import (div, flag_is_set, ip_key, ipv4_long, micros, packet_type,
                     payload_text, slot_of)
