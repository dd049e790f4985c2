"""Fixed values that results depend on: names, suffixes, markers, flag bits and orders."""

from __future__ import annotations

# Top-level domains that make a bare dotted string a host name.
TLDS = """
com net org info biz edu gov mil int io co ai app dev xyz top site online shop store live life world space
website tech cloud digital link click download stream host press news blog wiki zone systems network
tk ml ga cf gq pw cc ws su buzz icu cyou quest monster bond sbs rest fun work loan men date party review trade
science racing
uk de fr nl es it pl ru ua cn jp kr in br mx ca au nz za tr ir vn id th ph my sg hk tw se no fi dk cz sk hu ro bg
gr pt be ch at ie us tv me eu asia
""".split()

# File extensions and attribute names that are never taken for a top-level domain.
NOT_TLDS = """
py pyc pyd pyo txt md rst json xml yaml yml obj fbx abc usd usda usdc usdz stl ply gltf glb dae blend blend1
exr png jpg jpeg tif tiff tga bmp hdr webp mp3 wav ogg flac mp4 mov avi mkv zip tar gz bz2 xz 7z rar csv log ini cfg
conf toml html htm css js ts so dll dylib osl oso osotmp sqlite db bak tmp cache lock sh bat ps1 cmd vbs
self types ops utils context data app handlers
""".split()

# Tools often used to fetch and run a second stage; searched for in lower-cased strings.
TOOLS = [
    "powershell", "pwsh.exe", "cmd.exe", "cmd /c", "cmd /k", "curl ", "wget ", "certutil", "bitsadmin", "mshta", "rundll32", "regsvr32",
    "wscript", "cscript", "schtasks", "invoke-webrequest", "invoke-expression", "downloadstring", "-encodedcommand",
    "-windowstyle hidden", "/bin/sh", "/bin/bash", "bash -c", "sh -c", "osascript",
]

# Marks of a script that arranges to run again.
PERSISTENCE = [
    "start menu\\programs\\startup", "start menu/programs/startup", "currentversion\\run", "currentversion/run",
    "software\\microsoft\\windows\\currentversion\\run", ".config/autostart", "library/launchagents", "library/launchdaemons", "launchagents",
    "launchdaemons", "crontab", "/etc/cron", "systemd/user", "com.apple.loginitems", "schtasks", "/create /sc",
]

# Marks of a script that reads secret stores.
CREDENTIALS = [
    "login data", "cookies.sqlite", "logins.json", "key4.db", "key3.db", "signons.sqlite", "wallet.dat", "/.ssh", "\\.ssh", "id_rsa", "keychain",
    "user data\\default", "user data/default", "\\mozilla\\firefox\\profiles", "/mozilla/firefox/profiles", "google\\chrome\\user data",
    "browsermetrics", "credentials.json", ".aws/credentials", "metamask", "exodus\\exodus", "electrum", "keystore",
]

BENIGN, NOTABLE, ALARMING = 0, 1, 2
SEVERITIES = ("benign", "notable", "alarming")

# Names that a rule fires on, matched whole or as a dotted prefix.
# (rule, severity, where the name is met, names)
RULES = [
    ("x_network", ALARMING, "import call", "requests urllib2 urllib3 urllib.request http.client httplib httpx aiohttp socket ftplib telnetlib smtplib poplib imaplib xmlrpc.client paramiko"),
    ("x_network_listen", ALARMING, "import call", "socketserver SocketServer http.server BaseHTTPServer xmlrpc.server wsgiref.simple_server"),
    ("x_subprocess", ALARMING, "call", "subprocess os.system os.popen os.popen2 os.popen3 os.execv os.execve os.execl os.execlp os.execvp os.spawnl os.spawnv os.startfile pty.spawn commands.getoutput commands.getstatusoutput multiprocessing.Process"),
    ("x_dynamic_code", ALARMING, "call", "exec eval types.FunctionType types.CodeType"),
    ("x_lowlevel", ALARMING, "import", "ctypes cffi win32api win32com win32file win32process win32security pywintypes mmap"),
    ("x_persistence", ALARMING, "import", "winreg _winreg"),
    ("x_file_write", NOTABLE, "call", "shutil.copy shutil.copy2 shutil.copyfile shutil.copytree shutil.move os.rename os.replace os.write pathlib.Path.write_text pathlib.Path.write_bytes Path.write_text Path.write_bytes json.dump pickle.dump urllib.request.urlretrieve"),
    ("x_file_delete", NOTABLE, "call", "os.remove os.unlink os.rmdir os.removedirs shutil.rmtree pathlib.Path.unlink Path.unlink"),
    ("x_makedirs", NOTABLE, "call", "os.makedirs os.mkdir pathlib.Path.mkdir Path.mkdir"),
    ("x_compile_code", NOTABLE, "call", "compile marshal.loads"),
    ("x_deserialise", NOTABLE, "call", "pickle.load pickle.loads dill.load dill.loads"),
    ("x_opens_browser", NOTABLE, "import call", "webbrowser"),
    ("x_import_geometry", BENIGN, "call", "bpy.ops.import_scene bpy.ops.import_mesh bpy.ops.import_curve bpy.ops.import_anim bpy.ops.wm.obj_import bpy.ops.wm.usd_import bpy.ops.wm.alembic_import bpy.ops.wm.stl_import bpy.ops.wm.ply_import bpy.ops.wm.gpencil_import_svg bpy.ops.wm.collada_import"),
    ("x_ui_panel", BENIGN, "base", "bpy.types.Panel bpy.types.Operator bpy.types.Menu bpy.types.UIList bpy.types.Header bpy.types.PropertyGroup bpy.types.AddonPreferences bpy.types.NodeTree bpy.types.Node Panel Operator Menu PropertyGroup"),
    ("x_register", BENIGN, "call", "bpy.utils.register_class bpy.utils.unregister_class"),
]

# Calls that turn encoded or compressed bytes back; calls that hand back something to
# call; calls whose argument names something; names of the builtins namespace; imports at run time.
DECODE_CALLS = "base64.b64decode base64.b32decode base64.b16decode base64.b85decode base64.a85decode base64.decodebytes base64.decodestring base64.urlsafe_b64decode codecs.decode bytes.fromhex binascii.unhexlify binascii.a2b_base64 zlib.decompress bz2.decompress lzma.decompress gzip.decompress".split()
INDIRECTION_CALLS = "getattr vars globals locals __import__ importlib.import_module eval exec compile".split()
NAME_TAKING_CALLS = "getattr setattr hasattr __import__ importlib.import_module importlib.__import__ exec eval compile".split()
BUILTINS_NAMES = "__builtins__ builtins".split()
RUNTIME_IMPORTS = "__import__ importlib.import_module importlib.__import__".split()
BUILTIN_ROOTS = "exec eval compile open getattr setattr hasattr vars globals locals __import__ bytes bytearray str bpy".split()
EXECUTING_CALLS = "exec eval types.FunctionType types.CodeType".split()

# Statements that hide what a body does.
HIDING = ["x_obfuscation", "x_builtins_indirection", "x_indirect_call", "x_assembled_name", "x_opaque_blob"]

# Statements that put a file in the red tier.
RED = ["x_network", "x_network_listen", "x_subprocess", "x_living_off_land", "x_obfuscation", "x_builtins_indirection", "x_indirect_call", "x_assembled_name", "x_persistence", "x_credentials", "x_lowlevel"]

# The order in which reasons are given.
REASONS = """
scan_timed_out x_network x_network_listen x_subprocess x_living_off_land x_persistence x_credentials x_lowlevel
x_obfuscation x_builtins_indirection x_indirect_call x_assembled_name x_opaque_blob library_unc x_dynamic_code
autorun_unrecognised unreadable_script x_deserialise x_compile_code x_runtime_import x_decodes_data x_split_literal
x_file_delete x_file_write x_makedirs x_opens_browser x_handler_persist x_handler_register driver_not_simple
osl_bytecode library_drive_letter
""".split()

# Bit -> name of flags, and codes of types and modes.
TEXT_FLAGS = {0: "TXT_ISDIRTY", 2: "TXT_ISMEM", 3: "TXT_ISEXT", 4: "TXT_ISSCRIPT", 10: "TXT_TABSTOSPACES"}
DRIVER_FLAGS = {0: "DRIVER_FLAG_INVALID", 1: "DRIVER_FLAG_DEPRECATED", 3: "DRIVER_FLAG_RECOMPILE", 4: "DRIVER_FLAG_RENAMEVAR", 5: "DRIVER_FLAG_PYTHON_BLOCKED", 6: "DRIVER_FLAG_USE_SELF"}
DRIVER_TYPES = ["DRIVER_TYPE_AVERAGE", "DRIVER_TYPE_PYTHON", "DRIVER_TYPE_SUM", "DRIVER_TYPE_MIN", "DRIVER_TYPE_MAX"]
NODE_MODES = ["NODE_SCRIPT_INTERNAL", "NODE_SCRIPT_EXTERNAL"]

# Code points that a display could be steered with; tab and line feed are not among them.
STEERING = [(0x00, 0x08), (0x0B, 0x1F), (0x7F, 0x9F), (0x061C, 0x061C), (0x200B, 0x200F), (0x2028, 0x2029), (0x202A, 0x202E), (0x2060, 0x2060), (0x2066, 0x2069), (0xFEFF, 0xFEFF)]

# Limits of an inspection.
BLOB_CHARS, LITERAL_CHARS, PATH_CHARS, HOST_CHARS = 200, 4096, 400, 253
BODY_CHARS, NESTING, ALIAS_HOPS = 2 << 20, 180, 8
